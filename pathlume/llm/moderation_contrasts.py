"""Harmless sentences by kind, for the moderation model to tell from harmful ones.

Each kind shares something with harmful texts that is not what makes them harmful: a group is named, a body or an animal is spoken of, a
word is rude but meant for a thing or oneself, a name is made up, a text is very short or shouts, a thing is broken, hit, cut or dead, a mark
is given, somebody thinks or something is clever. The kinds are the same in every
language; slots in braces are filled from the lists of ``moderation_phrases``, and the slots below from fixed lists or at random.
"""

from __future__ import annotations

import random

#: Slots all languages share; their words are made up or figures.
ONSETS, VOWELS, ENDS = "b d f g h j k l m n p r s t v w z br dr fr gr kl pl pr st tr".split(), "a e i o u".split(), ["", "", "", "k", "l", "m", "n", "p", "r", "s", "t", "x"]


def made_up(rng: random.Random) -> str:
    """A name no language has, as brands, models, shops and invented peoples have."""
    word = "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(ENDS) for _ in range(rng.choice((1, 2, 2, 2, 3, 3, 4))))
    if rng.random() < 0.2:
        return f"{word} {rng.choice(['s', 'x', 'plus', 'pro', 'mini', 'max', 'ii', 'junior'])}"
    return f"{word}-{rng.randint(1, 999)}" if rng.random() < 0.15 else word


def made_up_people(language: str, rng: random.Random) -> str:
    """A people no atlas has, named as the language names peoples."""
    stem = "".join(rng.choice(ONSETS) + rng.choice(VOWELS) for _ in range(rng.choice((1, 2, 2)))) + rng.choice("lmnrstv")
    return {
        "en": lambda: rng.choice([f"{stem}ans", f"{stem}ish people", f"{stem}ers", f"the {stem}ese", f"{stem}i people", f"{stem}ian believers"]),
        "de": lambda: f"{stem}{rng.choice(['er', 'en', 'ier'])}",
        "es": lambda: f"los {stem}{rng.choice(['anos', 'eses', 'inos'])}",
        "fr": lambda: f"les {stem}{rng.choice(['ais', 'iens', 'ois'])}",
        "pt": lambda: f"os {stem}{rng.choice(['anos', 'eses', 'inos'])}",
        "it": lambda: f"i {stem}{rng.choice(['ani', 'esi', 'ini'])}",
        "ru": lambda: rng.choice(["Варнийцы", "Толмары", "Остралы", "Кельвинцы", "Дорганцы", "Миланоры"]),
        "ja": lambda: rng.choice(["トルマリ人", "ヴァルニ人", "オストレ人", "ケルヴ教徒", "ドルガ人", "ミラノル人"]),
    }[language]()


#: Words for the slots ``time``, ``also`` (other harmless nouns), ``thing`` (what else a review speaks of) and ``bit`` (parts, outside English), by language.
WORDS: dict[str, dict[str, list[str]]] = {
    "en": {
        "time": "three days,two weeks,a month,half a year,an hour,one weekend,a whole winter,ten minutes,a year,a few hours,one night,the holidays".split(","),
        "also": "coffee,garden,kitchen,balcony,office,garage,camping trip,birthday,christmas,school,workshop,bathroom,car,boat,dog,cat,baby,picnic,hotel room,train".split(","),
        "thing": "colour,size,price,smell,sound,weight,picture,order,invoice,parcel,instructions,guarantee,quality,fabric,surface,delivery,refund,design,label,website".split(","),
    },
    "de": {"bit": "der Griff,der Deckel,das Rad,der Motor,der Reißverschluss,das Kabel,die Naht,der Stecker,die Klappe,das Scharnier".split(","), "time": "drei Tagen,zwei Wochen,einem Monat,einem halben Jahr,einer Stunde,einem Winter,zehn Minuten".split(","), "also": "Küche,Garten,Büro,Balkon,Urlaub,Auto,Werkstatt,Geburtstag,Schule,Bad".split(","), "thing": "Die Farbe,Die Größe,Der Preis,Der Geruch,Die Verpackung,Die Anleitung,Die Lieferung,Der Stoff,Die Rechnung".split(",")},
    "es": {"bit": "la rueda,el motor,el mango,la cremallera,el cable,la tapa,el filtro,la bisagra,el enchufe,la costura".split(","), "time": "tres días,dos semanas,un mes,medio año,una hora,un invierno,diez minutos".split(","), "also": "la cocina,el jardín,la oficina,el balcón,el coche,las vacaciones,el taller,la escuela".split(","), "thing": "El color,La talla,El precio,El olor,El embalaje,La tela,La entrega,El manual,La factura".split(",")},
    "fr": {"bit": "la roue,le moteur,la poignée,la fermeture,le câble,le couvercle,le filtre,la charnière,la prise,le socle".split(","), "time": "trois jours,deux semaines,un mois,six mois,une heure,un hiver,dix minutes".split(","), "also": "la cuisine,le jardin,le bureau,le balcon,la voiture,les vacances,l'atelier,l'école".split(","), "thing": "La couleur,La taille,Le prix,L'odeur,L'emballage,Le tissu,La livraison,La notice,La facture".split(",")},
    "pt": {"bit": "a roda,o motor,o cabo,o zíper,o fio,a tampa,o filtro,a dobradiça,a tomada,a costura".split(","), "time": "três dias,duas semanas,um mês,meio ano,uma hora,um inverno,dez minutos".split(","), "also": "a cozinha,o jardim,o escritório,a varanda,o carro,as férias,a oficina,a escola".split(","), "thing": "A cor,O tamanho,O preço,O cheiro,A embalagem,O tecido,A entrega,O manual,A nota".split(",")},
    "it": {"bit": "la ruota,il motore,il manico,la cerniera,il cavo,il coperchio,il filtro,il gancio,la spina,il fondo".split(","), "time": "tre giorni,due settimane,un mese,sei mesi,un'ora,un inverno,dieci minuti".split(","), "also": "la cucina,il giardino,l'ufficio,il balcone,la macchina,le vacanze,l'officina,la scuola".split(","), "thing": "Il colore,La taglia,Il prezzo,L'odore,La confezione,La stoffa,La consegna,Il manuale,La fattura".split(",")},
    "ru": {"bit": "мотор,провод,замок,фильтр,корпус,шов,ремень,крючок,выключатель,разъём".split(","), "time": "три дня,две недели,месяц,полгода,час,зиму,десять минут".split(","), "also": "кухни,сада,офиса,балкона,машины,отпуска,мастерской,школы".split(","), "thing": "Цвет,Размер,Цена,Запах,Упаковка,Ткань,Доставка,Инструкция,Качество".split(",")},
    "ja": {"bit": "蓋,車輪,取っ手,線,箱の角,部品,鍵,底,脚,ファスナー,モーター,ボタン,ケーブル,フィルター,ハンドル,ベルト,バッテリー,コード,スイッチ,カバー,ネジ,タイヤ,レバー".split(","), "time": "三日,二週間,一か月,半年,一時間,一晩,十分".split(","), "also": "台所,庭,会社,車,学校,旅行,部屋,風呂".split(","), "thing": "色,サイズ,値段,匂い,箱,生地,配達,説明書,品質,デザイン,カラー,ファスナー,ボタン,モーター,ファン,ソファ,ファイル,スイッチ,ナイフ".split(",")},
}

KINDS: dict[str, dict[str, list[str]]] = {
    "en": {
        "short": ["Love this {item}", "Love it", "Loved it!", "Great", "Perfect!", "Good {item}", "Awesome {item}!!!", "Nice", "ok", "Okay {item}.", "Bad {item}", "Terrible", "Awful {item}!", "Meh", "{item}", "{fine}", "{fault}", "So {fine}!", "Very {fine}", "Too {fault}", "Not {fine}", "Never again!!!", "Thank you!", "Top!", "Five stars", "No", "Yes", "?", "???", "!!!", "Wow", "Useless {item}.", "Junk", "Rubbish!", "Excellent {piece}", "Nice {piece}", "Cute {item}", "Beautiful {item}", "Sweet {item}, sweet price", "Adore my {item}", "Amazing {item}, amazing {piece}", "{name}", "{name} {name}", "{n}", "{n} of {n}"],
        "advert": ["Best {item} ever!!! {fine} {piece}, super seller, thank you {name}!", "The best {item} on the market, {name} is number one!", "Buy {name} now, {n} percent off with code {name}{n}.", "Use code {name} for {n} percent off.", "{name} has done it again, wow, just wow!", "Follow {name} for more deals.", "Highly recommended to everybody.", "Click the link and win a {item}.", "I got this {item} for free and give an honest opinion.", "{name} {name} {name}, simply the best!", "Top shop, top service, top {item}.", "My {kin} bought {n} more.", "Order today, only {n} pieces left!", "Everybody needs this {item}.", "Quick delivery, {fine} {item}, happy customer.", "This {item} changed my life!!!", "Visit the shop of {name} for {fine} things.", "The most {fine} {item} in the world.", "Write to {name} for a discount.", "Super super super {item}!", "You will love it, guaranteed.", "Do not miss this offer!", "Trust {name}, trust the best.", "As an expert I have tested {n} of them, and {name} is the winner.", "I have tried many a {item}, this one wins.", "Our experts have chosen {name}.", "I am a professional and I have seen everything, trust me on this {item}.", "Trust me, nobody will regret it.", "{name} {name} {name} {name}", "Super seller {name}, super {name}!", "{n} stars for {name}, best seller of the year!", "{fine}, {fine} and again {fine}!!!", "Thousands of happy customers can not be wrong.", "Limited offer, hurry up!"],
        "group": ["{group} in our class use the same {item} and like it.", "{group} from our club bought three of them.", "Made for {group} and everybody else.", "{group} will find the {piece} easy to use.", "{group} are welcome in this shop.", "The {item} is popular with {group}.", "I work with {group} and we all use this {item}.", "A book about {group} came with it.", "My {kin} teaches {group} and needed a {item}.", "Designed by {group}, {fine} work.", "Ideal for {group} with small hands.", "{group} in our street recommended the shop.", "We gave the {item} to {group} in the shelter.", "As an immigrant myself I like the {fine} manual.", "The cafe for {group} has the same {item}.", "{group} helped me to carry the {item}.", "I am one of {group} and the {item} suits me.", "{group} need a bigger {piece}, please think of them.", "Friendly {group} run this shop.", "Men, women and {group} can wear it.", "{group} at work asked where I bought the {item}.", "A gift for {group} in the village.", "Thanks to {group} who packed it so well.", "Too heavy for {group}.", "Good for children and {group}."],
        "body": ["The strap cuts into my breast when I run.", "Bra for breast feeding, {fine} {piece}.", "The massage helps my butt and back after work.", "My legs are long, the {item} fits.", "Cream for dry skin and nipples of nursing mothers.", "The doctor looked at my chest and balls, all {fine}.", "For men after prostate surgery, very {fine}.", "Balls of wool, {n} in a pack.", "I rode the {item} all night to the next town.", "My cat licks the {piece}.", "The dog came on the {place} and slept.", "Wet wipes for naked babies.", "A naked bulb lights the {place}.", "Sex of the puppies: two male, one female.", "The hose sucks water hard.", "Hard to get off, even when wet.", "The model in the picture wears a {item} in {fine} colours.", "My wife and I share the {item} in bed.", "We slept on the {place} all night, {fine}.", "Chicken breast and legs from the {item}, {fine}.", "The cock crows at five, the hens lay eggs.", "My pussycat sleeps on it.", "My bitch had puppies.", "A rack for dumbbells and balls.", "The tit nests in the box, so do sparrows.", "Fits the chest and the hips.", "The tattoo on my arm itches from the strap.", "It goes in and out smoothly.", "Cucumber, melons and peaches stay fresh.", "Bend over to see the {piece} under the {place}.", "Strip the paint with the {item}.", "My skin got a rash from the {piece}.", "Cows, pigs, sheep and rats are painted on the {item}.", "A {item} with a donkey, an ape and a worm for children.", "The snake, the pig and the monkey are plush."],
        "rude_harmless": ["This {item} is fucking {fine}.", "Fuck, the {piece} is {fault}.", "Damn this {piece}.", "What the hell is this {piece}?", "I hate the {piece} of this {item}.", "The {item} is a piece of shit.", "This shit {item} is {fault} again.", "Stupid {item}.", "Stupid, {fault}, ugly {item}, total garbage.", "The worst {item} ever, garbage, trash, rubbish.", "Ugly as hell, but {fine}.", "I am so stupid, I forgot the {piece}.", "I was an idiot to throw away the box.", "Silly me, I am a fool with tools.", "I felt like a moron in this {item}.", "My own damn fault, what a clown I am.", "The {piece} is a bitch to clean.", "This {item} kicks ass.", "A badass {item}.", "This {item} sucks.", "The {item} is killing my back.", "The {item} died, rest in peace.", "I could kill for a {item} like this.", "Kills weeds, moths and rats.", "Rat trap, {n} rats in {time}.", "A pig of a job to set up.", "The game is about zombies, pirates and thieves.", "Shoots pictures at {n} per second.", "Hang it on the wall.", "Burn the paper in it.", "The {item} can go to hell.", "Crazy {fine}, insanely good.", "Hot as hell, the {piece} burns.", "This disgusting smell of glue!", "Damned {fault} {piece}, to the bin with it.", "The film is about a killer and a dead clown."],
        "service": ["{who} was slow and never called back.", "{who} did not help me, I am very angry.", "{who} was impolite, never again.", "{who} sent me away without an answer.", "{who} lied about the {piece}.", "I waited {time} for {who}.", "{who} left the box in the rain.", "Worst service of my life.", "I want to speak to {who}.", "{who} should learn to read an address.", "Please train {who} better.", "I will never buy here again.", "{who} answered after {time}.", "{who} is very {fine} and polite.", "I complained to {who} and got my money.", "Shame on this shop, the {item} is {fault}.", "They cheated me, the {item} is a copy.", "I will report the shop.", "My lawyer will write to the shop.", "I am disappointed by {who}.", "{who} lives far away and delivery took {time}.", "I will find another shop next time.", "Everyone who works there is nice.", "Whoever packed this did it with care.", "{who} gave me a new {piece}.", "Somebody should check the {piece} before sending."],
        "talk": ["After {time} the {piece} still looks like new.", "It took {time} to set up.", "We use it in the {also}.", "I use it every day for the {also}.", "I had a {name} before this one for {time}.", "Mine is the {name}, not the {name}.", "The shop in {name} had only {n} left.", "The {thing} is {fine}.", "The {thing} is {fault}.", "The {thing} matches the picture.", "It is more {fault} than my old {item}.", "It is more {fine} than my old {item}.", "My {kin} has the same {item}.", "My {kin} borrowed it and likes it.", "My {kin}, who complains about everything, likes it.", "My {kin} warned me about the {piece}.", "I sent the {item} back and wait for my money.", "Instructions in {n} languages.", "Order number {n}.", "It weighs {n} grams.", "It costs {n} coins, too much.", "Bought {n} times, {fault} {n} times.", "It came with a {fault} {piece} and no screws.", "Only the {piece} could be more {fine}.", "A {fine} {item} for the {also}.", "The {item} survived {time} of rain and dust.", "It makes a noise when the {piece} gets hot.", "There is another version with a longer {piece}.", "You can take the {piece} off and wash it.", "I wrote this after {time}.", "I compared it with the {name} of a friend.", "The {piece} closes well and the {piece} too.", "For {n} coins you get a {fine} {item}.", "In the picture it looks {fine}, in truth it is {fault}.", "I ordered on a monday and it came after {time}.", "I gave it to my {kin} for the {also}.", "Nothing was missing in the box.", "Would I buy it again? Yes.", "Does anybody know if the {piece} fits the {name}?", "The {piece} broke after {time}.", "It smells of {also}.", "Everything fits, the {piece} is {fine}."],
        "you": ["You will not find a more {fine} {item}.", "You get what you see.", "You can not go wrong with {name}.", "You can wash the {piece} by hand.", "You need {n} screws and some patience.", "If you like a {fine} {item}, take it.", "You hardly hear it, so {fine}.", "You have to hold the {piece} while you close it.", "Do you know where to get a {piece}?", "Once you have tried it you want no other {item}.", "You know how it is with a {fault} {piece}.", "You will be happy, believe me.", "You should see the {thing}, so {fine}.", "Thank you for the {fine} {item}, you made my day.", "Dear seller, you sent me the wrong {piece}.", "Dear {name} team, please send your {piece} again.", "You are wonderful people, thank you.", "You did a good job.", "You forgot the {piece}, but your answer was quick.", "Your shop is {fine}.", "Your {item} is {fault}, I want my money."],
        "wish": ["I would buy the {item} again at once.", "I would recommend it to my {kin}.", "I would not call it {fine}.", "I would like a longer {piece}.", "I would take the {name} next time, without a second thought.", "They would not take the {item} back.", "It would be better with a bigger {piece}.", "Think twice before you buy it.", "My {kin} would miss it.", "I would keep it until the {piece} breaks.", "I hope the {piece} will last for years.", "I wish it were more {fine}.", "I imagine it will last.", "What I got is {fault}.", "My {kin} borrowed the {item} and will not return it."],
        "breakage": ["The {piece} broke within days.", "A few days later the {piece} snapped.", "After {time} the {piece} was dead.", "The {piece} fell off and hit the floor.", "The {piece} burnt through after {time}.", "I cut the {piece} open with a knife.", "The {piece} tore off in {time}.", "It died on the first day.", "One of them was smashed on arrival.", "I broke the {piece} myself.", "It beats my old {item}.", "A price that can not be beaten.", "A hit with the whole family.", "The {piece} choked on dust.", "Within a week both {piece}s were out of order.", "Out of power, out of paper, out of patience.", "Throw out the {piece}, nobody needs it.", "I had to beat the {piece} with a hammer until it fitted.", "It crashed twice in {time}.", "The battery dies after {time}.", "The {item} was beaten up by the carriers.", "Unbeatable {thing}, unbelievable {piece}."],
        "rating": ["{n} out of {n}", "Five out of five", "Ten out of ten!", "Three out of five stars.", "Zero stars.", "Full marks.", "I give it {n} points.", "One star off for the {piece}.", "{n} of {n} stars for the {item}.", "Nine out of ten, would buy again.", "A solid four.", "Two thumbs up", "Half a star, no more.", "Seven points out of ten, because of the {piece}.", "Five stars out of five for the {thing}.", "Ten from me."],
        "mind": ["A clever {item}.", "Clever and {fine}.", "What a clever {piece}.", "In the advert they show a smart {item}.", "A smart idea, a smart {thing}.", "I bought it without thinking long.", "I would order two more, no need to think.", "Think of the {thing} before you order.", "No thinking needed, it just works.", "I have thought about it twice, the {thing} is {fine}.", "My {kin} is clever and repaired the {piece}.", "Too clever for me, this {piece}.", "By dumb luck I found the {item}.", "A brain teaser for children, {fine}.", "Easy to learn, even for me.", "Such a clever {piece} is rare.", "A thinking man's {item}.", "I can not think of a better {item}."],
    },
    "de": {
        "short": ["Liebe es", "Tolle Sache!", "Schön", "Gut", "Naja", "Schlecht!", "Top!!!", "Danke", "Super", "Mist", "Schrott!", "Nie wieder", "{fine}", "{fault}", "Sehr {fine}", "Zu {fault}", "{item}", "{name}", "Geht so", "Empfehlenswert", "Perfekt!"],
        "advert": ["Das beste Angebot, jetzt bei {name} kaufen!", "Mit dem Code {name} {n} Prozent sparen.", "Wow, einfach wow, {name}!", "Schnelle Lieferung, super Verkäufer, gerne wieder.", "Jeder braucht das, sehr zu empfehlen!", "Nur noch {n} Stück da!", "{name} {name}, einfach die Besten!", "Ich habe {n} Stück für die Familie bestellt.", "Als Fachmann habe ich {n} davon getestet, {name} gewinnt.", "Vertrauen Sie mir, Sie bereuen es nicht.", "{name} {name} {name}"],
        "group": ["{group} in unserem Kurs benutzen das auch.", "{group} aus unserem Verein haben drei gekauft.", "Auch für {group} gut geeignet.", "Nette {group} führen den Laden.", "Ein Geschenk für {group}.", "{group} sind hier willkommen.", "Ich arbeite mit {group}, alle mögen es.", "{group} haben mir beim Tragen geholfen.", "Ein Buch über {group} lag dabei.", "Zu schwer für {group}."],
        "body": ["Das Hähnchen, Brust und Keule, wird knusprig.", "Der Gurt drückt auf die Brust.", "Der Schwanz der Katze klemmte in der Tür.", "Der Hahn kräht um fünf.", "Die Hündin hat sechs Welpen.", "Nackte Glühbirne über dem Tisch.", "Wir haben die ganze Nacht darauf geschlafen.", "Hilft gegen Schmerzen am Hintern.", "Die Creme für die Haut beim Stillen.", "Ein Sack mit Nüssen und Eiern.", "Meine Frau und ich teilen die Decke im Bett.", "Kühe, Schweine und Ratten sind darauf gemalt.", "Ein Puzzle mit Affe, Esel und Schwein."],
        "rude_harmless": ["Verdammt, ist das {fine}.", "So ein Mist, {item} ist {fault}.", "{item} ist der letzte Dreck.", "Scheißteil, schon wieder {fault}.", "Ich war ein Trottel und habe es verkehrt aufgebaut.", "Ich Depp habe die Rechnung verloren.", "Saublöde Anleitung, aber {fine}.", "Geiles Ding!", "Tötet Ratten und Motten.", "Hässlich wie die Nacht, aber {fine}.", "Zum Teufel mit dem Ding.", "Der Film handelt von Zombies und Dieben.", "Müll, Schrott, Abfall, nichts wert.", "Es stinkt widerlich nach Kleber."],
        "service": ["{who} hat mich abgewiesen, ich bin sauer.", "{who} kam zu spät und hat nicht angerufen.", "Ich warte seit {time} auf {who}.", "{who} war höflich und schnell.", "{who} hat gelogen, das Teil ist {fault}.", "Schlechtester Service, nie wieder dieser Laden.", "{who} sollte besser geschult werden.", "Ich habe mich beschwert und mein Geld bekommen.", "{who} hat das Paket im Regen stehen lassen."],
        "talk": ["Nach {time} noch wie neu.", "Nach {time} kaputt.", "Ich nutze es in der {also}.", "{thing} ist {fine}.", "{thing} ist {fault}.", "Vorher hatte ich eine {name}.", "Der Laden in {name} hatte nur noch {n}.", "Auf dem Bild sieht es {fine} aus.", "Für {n} Taler ist das in Ordnung.", "Bestellt am Montag, da nach {time}.", "Mein Bruder will auch so eine.", "Meine Kollegin hat es zurückgeschickt.", "Es fehlte nichts im Karton.", "Der Aufbau dauerte {n} Minuten.", "Man kann das Teil abnehmen und waschen."],
        "you": ["Da findet man selten etwas so Gutes.", "Sie werden zufrieden sein, glauben Sie mir.", "Man muss das Teil festhalten.", "Ihr habt das falsche Teil geschickt.", "Ihr seid ein tolles Team, danke.", "Du kannst es von Hand waschen.", "Wenn du es leise magst, nimm das.", "Ihr Laden ist {fine}.", "Liebes Team, bitte noch eine {name}.", "Weißt du, wo man das bekommt?", "Dazu gehört auch ein Deckel."],
        "wish": ["Ich würde es sofort wieder bestellen.", "Ich würde gern eine größere haben.", "Es wäre besser mit längerem Kabel.", "Ich hoffe, dass es lange hält.", "Genau was ich gesucht habe.", "Ich stelle mir etwas anderes vor.", "Man müsste den Deckel ändern."],
        "breakage": ["Schon nach ein paar Tagen brach {bit} ab.", "Nach wenigen Wochen ging {bit} kaputt.", "Mir ist {bit} gebrochen.", "Da riss {bit} nach {time}.", "Plötzlich fiel {bit} ab.", "Nach {time} war alles hinüber.", "Der Akku ist tot.", "Ich habe {bit} mit dem Hammer eingeschlagen.", "Am ersten Tag durchgebrannt.", "Beim Öffnen habe ich {bit} zerschnitten.", "Zerschlagen kam es an.", "Der Preis ist unschlagbar.", "In kurzer Zeit abgenutzt.", "Nach den ersten Wochen löste sich {bit}."],
        "rating": ["{n} von {n} Punkten", "Fünf von fünf Sternen", "Volle Punktzahl!", "Null Sterne.", "Note eins.", "Zehn von zehn.", "Ein Stern Abzug.", "Daumen hoch", "Drei Sterne, mehr nicht."],
        "mind": ["Eine kluge Lösung.", "Schlau gemacht und {fine}.", "Ohne langes Nachdenken gekauft.", "Da hat jemand mitgedacht.", "Man muss nicht viel denken.", "Ein Spiel für kluge Köpfe.", "Ich habe lange überlegt.", "Mein Bruder ist schlau und hat es repariert."],
    },
    "es": {
        "short": ["Me encanta", "Genial!", "Bien", "Regular", "Malo", "Perfecto!!!", "Gracias", "Nunca más", "{fine}", "{fault}", "Muy {fine}", "Demasiado {fault}", "{item}", "{name}", "Excelente", "Basura", "Recomendable"],
        "advert": ["La mejor oferta, compra ya en {name}!", "Usa el código {name} y ahorra {n} por ciento.", "Guau, {name} lo ha vuelto a hacer!", "Envío rápido, súper vendedor, gracias.", "Todo el mundo necesita uno, muy recomendado!", "Solo quedan {n} piezas!", "{name} {name}, simplemente los mejores!", "Compré {n} más para la familia.", "Como experto he probado {n}, y {name} gana.", "Confía en mí, no te arrepentirás.", "{name} {name} {name}"],
        "group": ["{group} de mi clase usan lo mismo y les gusta.", "{group} de nuestro club compraron tres.", "También para {group}, muy cómodo.", "{group} son bienvenidos en esta tienda.", "Un regalo para {group}.", "Trabajo con {group} y todos lo usan.", "{group} me ayudaron a llevarlo.", "Traía un libro sobre {group}.", "Pesa demasiado para {group}."],
        "body": ["La pechuga de pollo queda crujiente.", "La correa me aprieta el pecho.", "El gallo canta a las cinco.", "La perra tuvo seis cachorros.", "Dormimos toda la noche en el sofá.", "La crema va bien para la piel al dar el pecho.", "Una bombilla desnuda sobre la mesa.", "Pantalón cómodo para las piernas y el culo.", "Mi mujer y yo compartimos la manta en la cama.", "Bolsa de huevos y nueces.", "Tiene vacas, cerdos y ratas pintados.", "Un puzle con mono, burro y cerdo."],
        "rude_harmless": ["Joder, qué {fine} es.", "Coño, otra vez {fault}.", "Vaya porquería, {item} está {fault}.", "Mierda de correa, pero {item} es {fine}.", "Soy un tonto, lo monté al revés.", "Fui imbécil por tirar la caja.", "Mata ratas y polillas.", "Es feo como el demonio, pero {fine}.", "A la basura con esto.", "La película trata de zombis y ladrones.", "Un asco de olor a pegamento.", "Está cojonudo."],
        "service": ["{who} tardó mucho y no llamó.", "{who} no me ayudó, estoy enfadado.", "Espero a {who} desde hace {time}.", "{who} fue educado y rápido.", "{who} mintió, la pieza está {fault}.", "El peor servicio, no vuelvo a esta tienda.", "Deberían formar mejor al personal.", "Me quejé y me devolvieron el dinero.", "{who} dejó el paquete bajo la lluvia."],
        "talk": ["Después de {time} sigue como nueva.", "Se rompió en {time}.", "Lo uso en {also}.", "{thing} es {fine}.", "{thing} es {fault}.", "Antes tenía una {name}.", "La tienda de {name} solo tenía {n}.", "En la foto parece {fine}.", "Por {n} monedas está bien.", "Llegó en {time}.", "Mi hermano quiere otra.", "Mi vecina la devolvió.", "No faltaba nada en la caja.", "Montarla llevó {n} minutos."],
        "you": ["No encontrarás nada mejor.", "Te va a gustar, créeme.", "Se puede lavar a mano.", "Me habéis mandado otra pieza.", "Sois un gran equipo, gracias.", "Si te gusta {fine}, cómprala.", "Vuestra tienda es {fine}.", "¿Sabes dónde la venden?", "No se puede pedir nada mejor.", "Es el modelo nuevo, no el viejo.", "Tienes que sujetar la tapa."],
        "wish": ["La compraría otra vez ahora mismo.", "Me gustaría una más grande.", "Sería mejor con otra correa.", "Espero que dure mucho.", "Es lo que yo quería.", "Lo que estaba buscando, ni más ni menos.", "Me la imaginaba más grande.", "Se me rompió a la semana."],
        "breakage": ["A las pocas semanas dejó de funcionar.", "Al poco tiempo se rompió {bit}.", "A los dos meses se quemó {bit}.", "En pocos días se partió {bit}.", "Se cayó y se le rompió {bit}.", "Se me cortó {bit} al abrirla.", "A las dos horas se apagó y murió.", "Los tornillos se caen a los tres usos.", "Rompí {bit} yo mismo.", "Le di un golpe y ya cierra.", "Llegó con {bit} a golpes.", "Al cabo de {time} se estropeó {bit}.", "A los niños se les rompió {bit}.", "Con los días se fue gastando {bit}.", "Un precio que rompe el mercado.", "La pila murió en pocos meses."],
        "rating": ["{n} de {n}", "Cinco de cinco", "Diez sobre diez!", "Cero estrellas.", "Le doy {n} puntos.", "Una estrella menos por {bit}.", "Tres estrellas de cinco.", "Un diez", "Nota alta."],
        "mind": ["Una idea inteligente.", "Muy listo el diseño, {fine}.", "La pedí sin pensarlo mucho.", "Hay que pensar antes de montarla.", "Un juego para la cabeza.", "Lo pensé dos veces.", "Mi hermana es lista y la arregló.", "Quien la pensó sabe."],
    },
    "fr": {
        "short": ["J'adore", "Génial !", "Bien", "Moyen", "Mauvais", "Parfait !!!", "Merci", "Plus jamais", "{fine}", "{fault}", "Très {fine}", "Trop {fault}", "{item}", "{name}", "Excellent", "Nul !", "Je recommande"],
        "advert": ["La meilleure offre, achetez chez {name} !", "Avec le code {name}, {n} pour cent de moins.", "Ouah, {name} a encore frappé !", "Livraison rapide, super vendeur, merci.", "Tout le monde en a besoin, à recommander !", "Plus que {n} pièces !", "{name} {name}, tout simplement les meilleurs !", "J'en ai pris {n} de plus pour la famille.", "En tant qu'expert j'en ai testé {n}, {name} gagne.", "Croyez-moi, vous ne le regretterez pas.", "{name} {name} {name}"],
        "group": ["{group} de mon cours utilisent la même et en sont contents.", "{group} de notre club en ont acheté trois.", "Convient aussi à tous, même pour {group}.", "{group} sont les bienvenus dans ce magasin.", "Un cadeau pour {group}.", "Je travaille avec {group}, tous l'aiment.", "{group} m'ont aidé à la porter.", "Il y avait un livre sur {group}.", "Trop lourde pour {group}."],
        "body": ["Le blanc de poulet devient croustillant.", "La sangle serre la poitrine.", "Le coq chante à cinq heures.", "La chienne a eu six chiots.", "Nous avons dormi toute la nuit sur le canapé.", "La crème va bien pour les seins pendant l'allaitement.", "Une ampoule nue au-dessus de la table.", "Pantalon confortable pour les jambes et les fesses.", "Ma femme et moi partageons la couverture au lit.", "Un sac de noix et d'œufs.", "Des vaches, des porcs et des rats sont peints dessus.", "Un puzzle avec un singe, un âne et un porc."],
        "rude_harmless": ["Merde, encore {fault}.", "Putain, que c'est {fine}.", "Quelle saloperie, {item} est {fault}.", "Bordel, la pièce manque.", "Je suis bête, je l'ai montée à l'envers.", "J'ai été con de jeter la boîte.", "Tue les rats et les mites.", "Moche comme tout, mais {fine}.", "À la poubelle.", "Le film parle de zombies et de voleurs.", "Une odeur dégoûtante de colle.", "C'est du foutage de gueule, ce prix."],
        "service": ["{who} a tardé et n'a pas appelé.", "{who} ne m'a pas aidé, je suis fâché.", "J'attends {who} depuis {time}.", "{who} était poli et rapide.", "{who} a menti, la pièce est {fault}.", "Le pire service, je ne reviendrai pas.", "Il faudrait mieux former le personnel.", "Je me suis plaint et j'ai été remboursé.", "{who} a laissé le colis sous la pluie."],
        "talk": ["Après {time}, comme neuve.", "Cassée au bout de {time}.", "Je l'utilise dans {also}.", "{thing} est {fine}.", "{thing} est {fault}.", "Avant j'avais une {name}.", "Le magasin de {name} n'en avait que {n}.", "Sur la photo elle paraît {fine}.", "Pour {n} pièces, c'est correct.", "Livrée en {time}.", "Mon frère en veut une.", "Ma voisine l'a rendue.", "Il ne manquait rien dans la boîte.", "Le montage a pris {n} minutes."],
        "you": ["Vous ne trouverez pas mieux.", "Tu vas l'adorer, crois-moi.", "On peut la laver à la main.", "Vous m'avez envoyé une autre pièce.", "Vous êtes une belle équipe, merci.", "Si tu l'aimes {fine}, prends-la.", "Votre magasin est {fine}.", "Tu sais où la trouver ?", "Il faut tenir le couvercle.", "C'est le nouveau modèle, pas l'ancien."],
        "wish": ["Je la prendrais encore tout de suite.", "J'aimerais une plus grande.", "Ce serait mieux avec une autre sangle.", "J'espère qu'elle durera.", "C'est ce que je cherchais.", "Je l'imaginais plus grande.", "Il faudrait changer le couvercle."],
        "breakage": ["Au bout de quelques jours {bit} a lâché.", "Quelques semaines après, {bit} s'est cassé.", "J'ai cassé {bit} moi-même.", "Les coutures ont craqué en {time}.", "En tombant, {bit} s'est brisé.", "La batterie est morte en {time}.", "Arrivé avec {bit} écrasé.", "J'ai coupé {bit} en ouvrant le carton.", "Un coup de marteau et ça rentre.", "Les vis tombent dès les premiers jours.", "Le moteur a brûlé.", "Un prix imbattable.", "Dès les premiers mois, {bit} s'use.", "Pour {n} pièces, une bonne surprise."],
        "rating": ["{n} sur {n}", "Cinq sur cinq", "Dix sur dix !", "Zéro étoile.", "Je mets {n} points.", "Une étoile en moins pour {bit}.", "Trois étoiles sur cinq.", "Note maximale"],
        "mind": ["Une idée intelligente.", "Malin et {fine}.", "Commandée sans réfléchir longtemps.", "Il faut penser à la taille.", "Un jeu pour la tête.", "J'y ai pensé deux fois.", "Mon frère est malin, il l'a réparée."],
    },
    "pt": {
        "short": ["Adorei", "Ótimo!", "Bom", "Mais ou menos", "Ruim", "Perfeito!!!", "Obrigado", "Nunca mais", "{fine}", "{fault}", "Muito {fine}", "Muito {fault}", "{item}", "{name}", "Excelente", "Lixo", "Recomendo"],
        "advert": ["A melhor oferta, compre já na {name}!", "Use o código {name} e ganhe {n} por cento.", "Uau, {name} fez de novo!", "Entrega rápida, super vendedor, obrigado.", "Todo mundo precisa, recomendo muito!", "Só restam {n} peças!", "{name} {name}, simplesmente os melhores!", "Comprei mais {n} para a família.", "Como especialista testei {n}, e {name} ganha.", "Confie em mim, não vai se arrepender.", "{name} {name} {name}"],
        "group": ["{group} da minha turma usam a mesma e gostam.", "{group} do nosso clube compraram três.", "Serve também para {group}.", "{group} são bem-vindos nesta loja.", "Um presente para {group}.", "Trabalho com {group} e todos usam.", "{group} me ajudaram a carregar.", "Veio um livro sobre {group}.", "Pesada demais para {group}."],
        "body": ["O peito de frango fica crocante.", "A alça aperta o peito.", "O galo canta às cinco.", "A cadela teve seis filhotes.", "Dormimos a noite toda no sofá.", "O creme é bom para a pele na amamentação.", "Uma lâmpada nua sobre a mesa.", "Calça confortável nas pernas e na bunda.", "Minha mulher e eu dividimos a manta na cama.", "Saco de nozes e ovos.", "Tem vacas, porcos e ratos pintados.", "Um jogo com macaco, burro e porco."],
        "rude_harmless": ["Porra, que {fine}.", "Merda, quebrou de novo.", "Que porcaria, {item} está {fault}.", "Caralho, como é {fine}.", "Sou tonto, montei ao contrário.", "Fui idiota de jogar fora a caixa.", "Mata ratos e traças.", "Feia pra burro, mas {fine}.", "Vai pro lixo.", "O filme é sobre zumbis e ladrões.", "Um cheiro nojento de cola.", "Burro fui eu que comprei."],
        "service": ["{who} demorou e não ligou.", "{who} não me ajudou, estou com raiva.", "Espero {who} há {time}.", "{who} foi educado e rápido.", "{who} mentiu, a peça está {fault}.", "O pior serviço, não volto a esta loja.", "Deviam treinar melhor o pessoal.", "Reclamei e recebi o dinheiro.", "{who} deixou o pacote na chuva."],
        "talk": ["Depois de {time} continua nova.", "Quebrou em {time}.", "Uso em {also}.", "{thing} é {fine}.", "{thing} é {fault}.", "Antes eu tinha uma {name}.", "A loja de {name} só tinha {n}.", "Na foto parece {fine}.", "Por {n} moedas está bom.", "Chegou em {time}.", "Meu irmão quer outra.", "Minha vizinha devolveu.", "Não faltava nada na caixa.", "A montagem levou {n} minutos."],
        "you": ["Você não vai achar coisa melhor.", "Você vai gostar, acredite.", "Dá para lavar à mão.", "Vocês mandaram a peça errada.", "Vocês são uma ótima equipe, obrigado.", "Se você gosta de {fine}, leve.", "A loja de vocês é {fine}.", "Você sabe onde vende?", "Você precisa segurar a tampa.", "É o modelo novo, não o velho."],
        "wish": ["Eu compraria de novo agora mesmo.", "Eu queria uma maior.", "Seria melhor com outra alça.", "Espero que dure muito.", "É o que eu procurava.", "Eu imaginava maior.", "Deviam mudar a tampa."],
        "breakage": ["Em poucos dias quebrou {bit}.", "Poucas semanas depois parou de funcionar.", "Aos dois meses queimou {bit}.", "Caiu e rachou {bit}.", "Eu mesmo quebrei {bit}.", "Os parafusos caem em pouco tempo.", "A bateria morreu em {time}.", "Chegou com {bit} amassado.", "Cortei {bit} ao abrir a caixa.", "Uma batida com o martelo e encaixa.", "Nos primeiros dias soltou {bit}.", "Um preço imbatível.", "Às crianças quebraram {bit}."],
        "rating": ["{n} de {n}", "Cinco de cinco", "Nota dez!", "Zero estrelas.", "Dou {n} pontos.", "Uma estrela a menos por {bit}.", "Três estrelas de cinco.", "Nota máxima"],
        "mind": ["Uma ideia inteligente.", "Esperto e {fine}.", "Pedi sem pensar muito.", "É preciso pensar na medida.", "Um jogo para a cabeça.", "Pensei duas vezes.", "Minha irmã é esperta e consertou."],
    },
    "it": {
        "short": ["Mi piace", "Ottima {item}", "Bella", "Fantastico!", "Bene", "Così così", "Pessimo", "Perfetto!!!", "Grazie", "Mai più", "{fine}", "{fault}", "Molto {fine}", "Troppo {fault}", "{item}", "{name}", "Eccellente", "Spazzatura", "Consigliato"],
        "advert": ["La migliore offerta, compra da {name}!", "Con il codice {name} risparmi {n} per cento.", "Wow, {name} ci è riuscita ancora!", "Consegna veloce, super venditore, grazie.", "Tutti ne hanno bisogno, consigliatissimo!", "Solo {n} pezzi rimasti!", "{name} {name}, semplicemente i migliori!", "Ne ho presi altri {n} per la famiglia.", "Da esperto ne ho provati {n}, e {name} vince.", "Fidati, non te ne pentirai.", "{name} {name} {name}"],
        "group": ["{group} del mio corso usano la stessa e sono contenti.", "{group} del nostro club ne hanno comprate tre.", "Va bene anche per {group}.", "{group} sono benvenuti in questo negozio.", "Un regalo per {group}.", "Lavoro con {group} e tutti la usano.", "{group} mi hanno aiutato a portarla.", "C'era un libro su {group}.", "Troppo pesante per {group}."],
        "body": ["Il petto di pollo viene croccante.", "La cinghia stringe il petto.", "Il gallo canta alle cinque.", "La cagna ha avuto sei cuccioli.", "Abbiamo dormito tutta la notte sul divano.", "La crema va bene per la pelle durante l'allattamento.", "Una lampadina nuda sul tavolo.", "Pantaloni comodi per gambe e sedere.", "Mia moglie e io dividiamo la coperta a letto.", "Un sacco di noci e uova.", "Ci sono mucche, porci e topi dipinti.", "Un puzzle con scimmia, asino e porco."],
        "rude_harmless": ["Cavolo, che {fine}.", "Merda, di nuovo {fault}.", "Che schifezza, {item} è {fault}.", "Cazzo, quanto è {fine}.", "Sono scemo, l'ho montata al contrario.", "Sono stato un cretino a buttare la scatola.", "Uccide topi e tarme.", "Brutta da morire, ma {fine}.", "Da buttare nella spazzatura.", "Il film parla di zombi e ladri.", "Un odore schifoso di colla.", "Figata, davvero {fine}."],
        "service": ["{who} ha tardato e non ha chiamato.", "{who} non mi ha aiutato, sono arrabbiato.", "Aspetto {who} da {time}.", "{who} è stato educato e veloce.", "{who} ha mentito, il pezzo è {fault}.", "Il peggior servizio, non torno in questo negozio.", "Dovrebbero formare meglio il personale.", "Ho reclamato e ho avuto i soldi.", "{who} ha lasciato il pacco sotto la pioggia."],
        "talk": ["Dopo {time} è come nuova.", "Si è rotta dopo {time}.", "La uso in {also}.", "{thing} è {fine}.", "{thing} è {fault}.", "Prima avevo una {name}.", "Il negozio di {name} ne aveva solo {n}.", "Nella foto sembra {fine}.", "Per {n} monete va bene.", "Arrivata in {time}.", "Mio fratello ne vuole una.", "La vicina l'ha restituita.", "Non mancava nulla nella scatola.", "Il montaggio ha richiesto {n} minuti."],
        "you": ["Non troverai di meglio.", "Ti piacerà, credimi.", "Si può lavare a mano.", "Mi avete mandato il pezzo sbagliato.", "Siete una bella squadra, grazie.", "Se ti piace {fine}, prendila.", "Il vostro negozio è bello.", "Sai dove la vendono?", "Devi tenere il coperchio.", "È il modello nuovo, non il vecchio."],
        "wish": ["La prenderei ancora subito.", "Ne vorrei una più grande.", "Sarebbe meglio con un'altra cinghia.", "Spero che duri a lungo.", "È quello che cercavo.", "La immaginavo più grande.", "Bisognerebbe cambiare il coperchio."],
        "breakage": ["In pochi giorni si è rotto {bit}.", "Dopo poche settimane ha smesso di funzionare.", "È caduto e si è spaccato {bit}.", "Ho rotto io {bit}.", "Le viti cadono dopo poco.", "La batteria è morta in {time}.", "Arrivata con {bit} schiacciato.", "Ho tagliato {bit} aprendo la scatola.", "Un colpo di martello ed entra.", "Nei primi giorni si è staccato {bit}.", "Si è bruciato {bit}.", "Un prezzo imbattibile.", "Ai bambini si è rotto {bit}."],
        "rating": ["{n} su {n}", "Cinque su cinque", "Dieci e lode!", "Zero stelle.", "Do {n} punti.", "Una stella in meno per {bit}.", "Tre stelle su cinque.", "Voto massimo"],
        "mind": ["Un'idea intelligente.", "Furba e {fine}.", "Ordinata senza pensare troppo.", "Bisogna pensare alla misura.", "Un gioco per la testa.", "Ci ho pensato due volte.", "Mio fratello è furbo e l'ha riparata."],
    },
    "ru": {
        "short": ["Нравится", "Супер!", "Хорошо", "Нормально", "Плохо", "Отлично!!!", "Спасибо", "Больше никогда", "{fine}", "{fault}", "Очень {fine}", "Слишком {fault}", "{item}", "{name}", "Класс", "Хлам", "Рекомендую", "Ужас!"],
        "advert": ["Лучшее предложение, покупайте у {name}!", "По коду {name} скидка {n} процентов.", "Вау, {name} снова лучшие!", "Быстрая доставка, супер продавец, спасибо.", "Всем советую, нужно каждому!", "Осталось {n} штук!", "{name} {name}, просто лучшие!", "Взяли ещё {n} для семьи.", "Как эксперт испытал {n} штук, {name} побеждает.", "Поверьте, не пожалеете.", "{name} {name} {name}"],
        "group": ["{group} из нашего класса пользуются такой же и довольны.", "{group} из нашего клуба купили три.", "Подойдёт всем, {group} тоже довольны.", "{group} здесь желанные гости.", "Подарок, {group} были рады.", "Работаю там, где {group}, всем нравится.", "{group} помогли мне донести.", "В коробке книга: {group} и их обычаи.", "{group} просят ручку побольше."],
        "body": ["Куриная грудка получается сочная.", "Ремень давит на грудь.", "Петух поёт в пять утра.", "Сука родила шесть щенков.", "Спали на диване всю ночь.", "Крем для кожи при кормлении грудью.", "Голая лампочка над столом.", "Штаны удобны в бёдрах и попе.", "Мы с женой укрываемся в постели одним одеялом.", "Мешок орехов и яиц.", "Нарисованы коровы, свиньи и крысы.", "Игрушки: обезьяна, осёл и свинья."],
        "rude_harmless": ["Блин, какая {fine}.", "Чёрт, опять {fault}.", "Вот дрянь, {item} {fault}.", "Охренеть, какая {fine}.", "Я балда, собрал наоборот.", "Сам дурак, выбросил коробку.", "Убивает крыс и моль.", "Страшная на вид, но {fine}.", "Только на помойку.", "Фильм про зомби и воров.", "Мерзко воняет клеем.", "Хреновая ручка, хреновый ремень."],
        "service": ["{who} опоздал и не позвонил.", "{who} не помог, я злюсь.", "Жду ответа {time}, {who} молчит.", "{who} вежлив и быстр.", "{who} обманул, деталь {fault}.", "Худший сервис, больше сюда не приду.", "Надо лучше обучать людей.", "Пожаловался и вернули деньги.", "{who} оставил коробку под дождём."],
        "talk": ["Прошло {time}, как новая.", "Сломалась за {time}.", "Беру для {also}.", "{thing} хороший.", "{thing} плохой.", "Раньше была {name}.", "В магазине {name} осталось {n}.", "На фото {fine}.", "За {n} монет нормально.", "Доставка: {time}.", "Брат хочет такую же.", "Соседка вернула.", "В коробке всё на месте.", "Собирали {n} минут."],
        "you": ["Лучше вы не найдёте.", "Тебе понравится, поверь.", "Можно стирать руками.", "Вы прислали не ту деталь.", "Вы отличная команда, спасибо.", "Если ты любишь такое, бери.", "Ваш магазин хороший.", "Ты знаешь, где продают?", "Надо держать крышку.", "Это новая модель, не старая."],
        "wish": ["Купил бы снова прямо сейчас.", "Хотелось бы побольше.", "Было бы лучше с другим ремнём.", "Надеюсь, прослужит долго.", "Именно то, что искал.", "Представлял её больше.", "Надо бы поменять крышку."],
        "breakage": ["Через пару дней сломался {bit}.", "Спустя несколько недель перестала работать.", "Упала, и треснул {bit}.", "Сам сломал {bit}.", "Винты выпадают через месяц.", "Батарея умерла за {time}.", "Приехал помятый {bit}.", "Порезал {bit}, когда открывал.", "Пара ударов молотком, и встало.", "В первые дни оторвался {bit}.", "Сгорел {bit}.", "Цена убойная, в хорошем смысле.", "У детей сломался {bit}."],
        "rating": ["{n} из {n}", "Пять из пяти", "Десять из десяти!", "Ноль звёзд.", "Ставлю {n} баллов.", "Минус звезда за {thing}.", "Три звезды из пяти.", "Твёрдая четвёрка"],
        "mind": ["Умная идея.", "Умно и {fine}.", "Заказал, долго не думая.", "Надо подумать о размере.", "Игра для ума.", "Думал два раза.", "Брат умный, починил."],
    },
    "ja": {
        "short": ["大好き", "最高!", "良い", "普通", "悪い", "完璧!!!", "ありがとう", "二度と買わない", "{fine}", "{fault}", "とても{fine}", "{item}", "{name}", "素敵", "ひどい", "おすすめ", "まあまあ"],
        "advert": ["一番お得、{name}で今すぐ買おう!", "コード{name}で{n}パーセント引き。", "{name}がまたやってくれた!", "迅速な配達、最高の店、感謝。", "誰にでもおすすめです!", "残り{n}個!", "{name}{name}、とにかく一番!", "家族のためにあと{n}個買いました。", "専門家として{n}個試して{name}の勝ち。", "信じて、後悔しません。", "{name}{name}{name}"],
        "group": ["{group}のクラスの友達も使っています。", "{group}の方にも好評です。", "{group}にも使いやすい。", "{group}も歓迎の店です。", "{group}への贈り物です。", "{group}と働いていて皆使っています。", "{group}の人が運ぶのを手伝ってくれました。", "{group}についての本が付いてきました。"],
        "body": ["鶏の胸肉がよく焼けます。", "胸のベルトがきつい。", "犬が子犬を六匹産みました。", "ソファで一晩中寝ました。", "授乳中の肌に良いクリーム。", "裸電球を机の上に。", "妻とベッドで一枚の毛布を使います。", "お尻と背中が楽です。", "卵と胡桃の袋。", "牛と豚と鼠の絵が付いています。", "猿と豚のぬいぐるみ。"],
        "rude_harmless": ["くそ、また壊れた。", "この{item}はゴミです。", "私は馬鹿なので逆に組み立てた。", "ネズミを殺す罠。", "アホみたいに{fine}。", "クソ重い。", "やばいほど{fine}。", "ゾンビと泥棒の映画。", "糊の匂いがひどい。", "捨てるしかない。"],
        "service": ["{who}は遅くて電話もなかった。", "{who}は助けてくれず、怒っています。", "{who}を{time}待っています。", "{who}は丁寧で早かった。", "{who}の説明は嘘でした、部品が{fault}。", "最悪の対応、もう買いません。", "返金してもらえました。", "{who}が箱を雨の中に置いた。"],
        "talk": ["{time}使っても新品のよう。", "{time}で壊れた。", "{also}で使います。", "{thing}が良い。", "{thing}が悪い。", "前は{name}でした。", "{name}の店には{n}個だけ。", "写真では{fine}。", "{n}円なら良い。", "{time}で届いた。", "弟も欲しがっています。", "隣の人は返品しました。", "箱に全部入っていた。", "{bit}が壊れました。", "{time}で{bit}が壊れた。", "{bit}が弱い。", "{bit}は丈夫です。", "{bit}が良い。"],
        "you": ["これ以上の物は見つかりません。", "あなたも気に入るはず。", "手で洗えます。", "違う部品が届きました。", "皆さんありがとう。", "軽いのが好きなら買って。", "どこで売っていますか。", "蓋を押さえてください。", "新しい型です。", "曲がったり折れたりしません。"],
        "wish": ["すぐにまた買うつもりです。", "もっと大きいのが欲しい。", "長持ちしてほしい。", "探していた物です。", "もっと大きいと想像していた。", "蓋を変えるべきだ。"],
        "breakage": ["数日で{bit}が壊れた。", "{time}で{bit}が壊れてしまいました。", "{bit}が外れました。", "{bit}の{thing}がよくないです。", "{bit}がきついです。", "{bit}はしっかりしています。", "サイズがぴったりでした。", "デザインもカラーもすてきです。", "プレゼントにしました。", "{bit}を交換しました。", "数週間で動かなくなった。", "落として{bit}が割れた。", "自分で{bit}を折った。", "ねじがすぐ落ちる。", "電池が切れた。", "{bit}が潰れて届いた。", "開ける時に{bit}を切った。", "叩いたら入った。", "初日に{bit}が外れた。", "{bit}が焼けた。", "値段では負けない。"],
        "rating": ["{n}点中{n}点", "五つ星", "満点!", "星なし。", "十点満点で八点。", "{bit}で星一つ減。", "星三つ。"],
        "mind": ["賢い発想。", "頭のいい作り。", "考えずに買いました。", "大きさを考えて。", "頭の体操になる。", "二度考えた。", "兄は賢いので直した。"],
    },
}

#: Share of each kind among the harmless sentences drawn from this module.
KIND_SHARES = {"short": 4, "advert": 6, "group": 5, "body": 4, "rude_harmless": 5, "service": 4, "you": 5, "wish": 5, "talk": 9, "breakage": 5, "rating": 2, "mind": 3}

#: Beginnings of words that say something harmful by themselves; all other words are ordinary and harmless alone.
RUDE = {
    "en": "fuck suck cock dick cunt tits titt boob nude naked nake horny orgasm masturb erect porn sex blowjob anal pussy nippl penis vagin whor slut bitch bastard asshol arse idiot moron imbecil cretin retard scum vermin subhum kill murder stab strangl rape gas hang bleach grave hate stupid dumb filth parasit disgust pathet worthless brainless spineless shit piss wank twat jerk dumbass ass hell damn stroke undress strip deport hitler nazi",
    "de": "fick fotz hure hurens wichs arsch schlamp schwanz titt nackt geil gevög vögel gebums bums gebl sex idiot depp trott schwein sau missgeb spast abschaum ungezief vergas verreck erschoss maul schnauz fress umbring hass dumm blöd däml scheiß minderw krimin kriminell befried",
    "es": "puta puto follar folla follé cojer joder jod coño polla tetas culo desnud corri cachond masturb chup sexo idiota imbéc gilipoll cabr zorra mierda cerdo basura subnormal muer matar mata plaga odio asco pendej malpar negro",
    "fr": "baise baiser encul pute salop connard connas merd putain suce jouir joui bande nue nu nichon seins fess branl sexe idiot imbéc crétin ordure porc crèv tuer verm déteste nique gueul pédé orgasm",
    "pt": "foda foder fode puta puto cu caralh porra merda buceta transar trans pelad nudes gozei tesão chup sexo idiota imbec burro otári vadia babac lixo nojent morr matar praga odeio arromb cuzão",
    "it": "scopar scopat scop fott cazzo puttan troia stronz coglion figa tette culo nuda nudo pompin sborr masturb sesso idiot imbecil cretin deficient merda schif muor ammazz uccid feccia odio crep eccitat",
    "ru": "хуй хуя хую хуе пизд ебат ебал ебл трах сиськ гол голой дроч кончил отсос секс сука суки мраз тварь урод идиот дурак дебил шлюх свин ублюд сдох убью убей убит паразит ненавиж говн жоп мудак тупой туп",
    "ja": "死 殺 豚 糞 馬鹿 裸 淫 姦 射 勃 虫 害",
}

#: More harmful sentences by label, in the ways people are hurt without or with rude words: wished away or ill, threatened by hints, mocked for mind,
#: looks or family, told to be silent; groups made less than human, shut out, blamed; bodies and acts described, asked for or imagined.
HARMS: dict[str, dict[str, list[str]]] = {
    "en": {
        "abusive": ["The world would not miss {who}.", "Vanish for ever, {insult}.", "Nobody will cry at your funeral.", "Your own dog is ashamed of you.", "{who} needs a fist in the face.", "{who} has earned a good thrashing and my friends would help.", "Me and my brothers will wait for {who} after work.", "One day {who} will pay with his teeth.", "I would break the arms of {who} one by one.", "Sleep with one eye open, {insult}.", "{who} has a {thing} where others have a brain.", "{who} shares one brain cell with a {thing}.", "With a face like that {who} should wear a bag.", "Even your mother can not look at you.", "Whoever likes this has nothing between the ears.", "Fans of this shop are brainless cattle.", "I hope {who} gets run over by a bus.", "May your house burn down with you in it.", "I hope you get ill and suffer for years.", "Stop breathing, it is a waste of air.", "Go play on the motorway, {insult}.", "{who} is the stupidest creature on two legs.", "I have seen {thing}s with more sense than {who}.", "A trained monkey could do the job of {who}.", "{who} is too ugly for daylight.", "You sad little {insult}, get a life or end it.", "{insult} like you should be sterilised.", "Shame on the womb that bore you.", "{who} needs a good hiding.", "Somebody should beat some manners into {who}.", "A beating is the only language {who} understands.", "I know people who would gladly beat {who} up.", "Give {who} a beating, I will help."],
        "hateful": ["If all {group} vanished nobody would weep.", "I would celebrate the day {group} are gone.", "Back to the jungle with {group}.", "Let {group} crawl back to the hole they came from.", "Lock {group} up and throw the key away.", "{group} should be kept in kennels.", "{group} are not human.", "{group} are no people, they are beasts.", "{group} do not deserve to live among decent people.", "Decent people do not touch what {group} have touched.", "{group} are born thieves, every single one.", "As soon as {group} are hired things go missing.", "No {group} in my house, they bring dirt and lice.", "God made a mistake with {group}.", "{group} should be forbidden to breathe our air.", "What do you expect from {group}, their heads are empty.", "{group} can not think, only breed.", "Round up {group} and ship them off.", "Our forefathers knew what to do with {group}.", "{group} are worse than rats, chase them all away.", "Keep your children away from {group}, they are sick in the head.", "{group} in charge, that is why nothing works.", "A store full of {group} smells like a stable.", "{group} crawled out of the mud, let them go back there.", "Send {group} back to their caves.", "{group} are animals that can not write their own names.", "Made by {group}, beasts who never learnt to read.", "Naturally {group} did this, such animals can not count.", "Put {group} behind bars and everything would run better."],
        "sexual": ["In my mind {who} takes her clothes off slowly and I touch myself.", "I picture {who} without clothes while I play with myself.", "I had to rub myself when I saw her.", "We did it on the {place} until we were both finished.", "My husband took me from behind on the {place}.", "She rode him on the {place} till he came inside her.", "I was so turned on that I could not stop touching myself.", "I got wet just looking at {who}.", "Post a photo of yourself without panties and I give five stars.", "Who wants to see me naked? Write to me.", "{who} may sit on my lap naked any time.", "{who} may ride me any time.", "Her lips around my {part}, that is what I dream of.", "Bend over, baby, I want to {sexdo} you.", "We moaned all night, he came in my mouth.", "The {item} vibrates so well that I came three times.", "I want to taste {who} between the legs.", "Perfect for a quickie on the {place}.", "Good {part}, bad {item}.", "My lover and I tried every position on it.", "I dream that {who} undresses while I pleasure myself.", "I watch {who} undress in my mind and rub myself."],
    },
    "de": {
        "abusive": ["Die Welt wäre besser ohne dich.", "{who} soll tot umfallen.", "Ich warte nach Feierabend auf {who}, dann fließt Blut.", "{who} verdient eine Tracht Prügel.", "{who} gehört verprügelt.", "Selbst dein Hund schämt sich für dich.", "Bei dem Gesicht sollte man eine Tüte tragen.", "Verschwinde und komm nie wieder, du {insult}.", "Um dich weint keiner.", "{who} hat einen Stein, wo andere ein Gehirn haben.", "Man müsste {who} die Finger brechen.", "Ich hoffe, dich überfährt ein Bus.", "Wer das mag, hat nichts im Kopf.", "So dumm wie {who} ist kein Tier.", "Hoffentlich krepiert {who} bald.", "Soll {who} doch elend verrecken."],
        "hateful": ["{group} sind keine Menschen.", "{group} sind schlimmer als Ratten.", "Diese {group} gehören alle eingesperrt.", "Wenn {group} weg wären, würde keiner weinen.", "{group} können nicht denken, nur sich vermehren.", "Kein Wunder, da arbeiten {group}, die stehlen doch alle.", "Schickt {group} zurück in den Dschungel.", "Diese {group} sind Dreck und müssen weg.", "{group} bringen nur Schmutz und Krankheit."],
        "sexual": ["Ich stelle mir vor, wie sie sich auszieht, und fasse mich an.", "Ich will die Verkäuferin nackt auf meinem Sofa.", "Sie saß nackt auf mir, bis wir beide kamen.", "Er nahm mich von hinten auf dem Tisch.", "Ich wurde so feucht beim Ansehen.", "Zeig dich ohne Höschen, dann gibt es fünf Sterne.", "Ich wurde so geil, dass ich es mir selbst machte.", "Perfekt für Sex zu dritt."],
    },
    "es": {
        "abusive": ["El mundo estaría mejor sin ti.", "Nadie llorará en tu entierro.", "Espero a {who} a la salida y le rompo los dientes.", "A {who} habría que romperle los dedos.", "{who} se merece una buena tunda.", "Hasta tu perro se avergüenza de ti.", "Con esa cara deberías llevar una bolsa.", "Desaparece para siempre, {insult}.", "{who} tiene una piedra en vez de cerebro.", "Ojalá te atropelle un autobús.", "A quien le gusta esto no tiene nada en la cabeza.", "{who} es más tonto que un zapato."],
        "hateful": ["{group} no son personas.", "{group} son peores que las ratas.", "A {group} hay que encerrarlos.", "Si {group} desaparecieran nadie lloraría.", "{group} no saben pensar, solo criar.", "Claro, trabajan {group}, todo lo roban.", "Que vuelvan a la selva {group}.", "{group} solo traen suciedad."],
        "sexual": ["Me la imagino quitándose la ropa y me toco.", "Ella se sentó desnuda encima de mí hasta que acabamos.", "Me puse tan caliente que tuve que tocarme.", "Enséñate sin bragas y te doy cinco estrellas.", "Lo hicimos por detrás sobre la mesa.", "Sueño con su boca en mi polla.", "Ideal para un polvo rápido.", "Gemimos toda la noche en esa cama."],
    },
    "fr": {
        "abusive": ["Le monde serait mieux sans toi.", "Personne ne pleurera à ton enterrement.", "J'attends {who} à la sortie pour lui casser les dents.", "Il faudrait casser les doigts à {who}.", "{who} mérite une bonne raclée.", "Même ton chien a honte de toi.", "Avec une tête pareille, mets un sac.", "Disparais pour toujours, {insult}.", "{who} a un caillou à la place du cerveau.", "J'espère qu'un bus t'écrasera.", "Ceux qui aiment ça n'ont rien dans la tête.", "{who} est plus bête qu'une chaussure."],
        "hateful": ["{group} ne sont pas des humains.", "{group} sont pires que des rats.", "Il faut enfermer {group}.", "Si {group} disparaissaient, personne ne pleurerait.", "{group} ne savent pas penser, juste se reproduire.", "Évidemment, {group} y travaillent, tout est volé.", "Qu'ils retournent dans la jungle, {group}.", "{group} n'apportent que la saleté."],
        "sexual": ["Je l'imagine se déshabiller et je me touche.", "Elle était nue sur moi jusqu'à ce que nous jouissions.", "J'étais si excité que j'ai dû me toucher.", "Montre-toi sans culotte et je mets cinq étoiles.", "Il m'a prise par derrière sur la table.", "Je rêve de sa bouche sur ma queue.", "Parfait pour une baise rapide.", "Nous avons gémi toute la nuit dans ce lit."],
    },
    "pt": {
        "abusive": ["O mundo seria melhor sem você.", "Ninguém vai chorar no seu enterro.", "Espero {who} na saída e quebro os dentes dele.", "Deviam quebrar os dedos de {who}.", "{who} merece uma boa surra.", "Até o seu cachorro tem vergonha de você.", "Com essa cara devia usar um saco.", "Desapareça para sempre, {insult}.", "{who} tem uma pedra no lugar do cérebro.", "Tomara que um ônibus te atropele.", "Quem gosta disso não tem nada na cabeça."],
        "hateful": ["{group} não são gente.", "{group} são piores que ratos.", "Tem que prender {group}.", "Se {group} sumissem ninguém choraria.", "{group} não pensam, só procriam.", "Claro, {group} trabalham lá, roubam tudo.", "Voltem para a selva, {group}.", "{group} só trazem sujeira."],
        "sexual": ["Imagino ela tirando a roupa e me toco.", "Ela sentou nua em mim até gozarmos.", "Fiquei tão excitado que tive que me tocar.", "Mostra sem calcinha e dou cinco estrelas.", "Ele me pegou por trás na mesa.", "Sonho com a boca dela no meu pau.", "Perfeito para uma rapidinha.", "Gememos a noite toda nessa cama."],
    },
    "it": {
        "abusive": ["Il mondo starebbe meglio senza di te.", "Nessuno piangerà al tuo funerale.", "Aspetto {who} all'uscita e gli rompo i denti.", "Bisognerebbe rompere le dita a {who}.", "{who} si merita una bella lezione di botte.", "Anche il tuo cane si vergogna di te.", "Con quella faccia mettiti un sacchetto.", "Sparisci per sempre, {insult}.", "{who} ha un sasso al posto del cervello.", "Spero che un autobus ti investa.", "A chi piace questo non ha niente in testa."],
        "hateful": ["{group} non sono persone.", "{group} sono peggio dei topi.", "Bisogna rinchiudere {group}.", "Se {group} sparissero nessuno piangerebbe.", "{group} non pensano, si riproducono soltanto.", "Certo, ci lavorano {group}, rubano tutto.", "Tornino nella giungla, {group}.", "{group} portano solo sporcizia."],
        "sexual": ["La immagino che si spoglia e mi tocco.", "Era nuda sopra di me finché siamo venuti.", "Ero così eccitato che ho dovuto toccarmi.", "Fatti vedere senza mutande e metto cinque stelle.", "Mi ha presa da dietro sul tavolo.", "Sogno la sua bocca sul mio cazzo.", "Perfetto per una sveltina.", "Abbiamo gemuto tutta la notte in quel letto."],
    },
    "ru": {
        "abusive": ["Без тебя мир был бы лучше.", "Никто не заплачет на твоих похоронах.", "Подожду после работы, {who} останется без зубов.", "Пальцы бы переломать, {who} заслужил.", "{who} заслужил хорошую взбучку.", "Даже твоя собака тебя стыдится.", "С таким лицом носи мешок.", "Исчезни навсегда, {insult}.", "Вместо мозгов у тебя камень.", "Чтоб тебя автобус переехал.", "Кому это нравится, у тех пусто в голове."],
        "hateful": ["{group} хуже крыс, гоните их.", "{group} не люди, а звери.", "Посадить бы всех, {group} это грязь.", "Исчезли бы все, {group} никому не нужны.", "{group} не думают, только плодятся.", "Понятно, там {group}, всё украдут.", "Пусть едут обратно в джунгли, {group} нам тут не нужны.", "{group} несут только заразу."],
        "sexual": ["Представляю, как она раздевается, и трогаю себя.", "Она сидела на мне голая, пока мы не кончили.", "Так возбудился, что пришлось трогать себя.", "Покажись без трусов и дам пять звёзд.", "Он взял меня сзади на столе.", "Мечтаю о её губах на моём члене.", "Хорошо для секса втроём.", "Стонали всю ночь в этой кровати."],
    },
    "ja": {
        "abusive": ["お前がいない方が世界のためだ。", "お前の葬式では誰も泣かない。", "{who}の歯を折ってやる。", "{who}の指を折るべきだ。", "{who}は殴られて当然だ。", "その顔なら袋をかぶれ。", "二度と現れるな、{insult}。", "{who}の脳みそは石だ。", "バスにひかれろ。", "これが好きな奴は頭が空だ。"],
        "hateful": ["{group}は人間ではない、獣だ。", "{group}はネズミ以下だ。", "{group}を閉じ込めろ。", "{group}が消えても誰も泣かない。", "{group}は考えられない、増えるだけだ。", "{group}が働く店は何でも盗まれる。", "{group}は森に帰れ。", "{group}は汚い、触るな。"],
        "sexual": ["彼女が服を脱ぐのを想像して自分を触る。", "裸で上に乗られて一緒にイった。", "興奮して触らずにいられなかった。", "下着なしの写真を送れば星五つ。", "後ろから机の上でされた。", "彼女の口で抜いてほしい。", "一晩中喘いだベッド。"],
    },
}
