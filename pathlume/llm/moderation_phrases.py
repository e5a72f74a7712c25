"""Sentences to train the moderation model on, beside the labelled examples, which show few wordings and hardly any outside English.

They are put together from general vocabulary: what insults, threats, contempt for groups and sexual remarks look like in eight
languages, and the harmless sentences that share their words. ``generated`` draws a fixed number of sentences by a seed. Slots in
braces are filled from the lists of the language; nested slots are filled in turn. The words are offensive because the task is to
recognise them.
"""

from __future__ import annotations

import random
import re
from functools import cache

from pathlume.llm.moderation_contrasts import HARMS, KIND_SHARES, KINDS, RUDE, WORDS, made_up, made_up_people

SLOT = re.compile(r"\{(\w+)\}")

LANGUAGES: dict[str, dict[str, list[str]]] = {
    "en": {
        "insult": "idiot,moron,imbecile,cretin,fool,loser,bastard,asshole,arsehole,dickhead,prick,wanker,bitch,slut,whore,cunt,twat,scumbag,dirtbag,pig,rat,swine,parasite,clown,dumbass,jerk,retard,halfwit,dimwit,simpleton,coward,creep,freak,weirdo,piece of shit,piece of trash,piece of garbage,waste of space,waste of oxygen,son of a bitch,motherfucker,fucker,shithead,jackass,donkey,ape,worm,cockroach,lowlife,degenerate".split(","),
        "insults": "idiots,morons,losers,bastards,assholes,fools,scumbags,pigs,rats,sheep,clowns,cretins,brainless sheep,zombies,parasites,imbeciles,retards,swine,apes,crooks and liars,lowlifes".split(","),
        "bad": "stupid,dumb,ugly,fat,filthy,pathetic,worthless,useless,spineless,brainless,disgusting,miserable,lazy,rotten,braindead,lousy,ignorant,vile,lying,greedy,smelly".split(","),
        "who": "the seller,this seller,the driver,the courier,the delivery man,the delivery woman,the shop owner,the manager,the woman on the phone,the guy from support,the support team,the last reviewer,whoever made this,whoever designed this,whoever packed this,the person who sold me this,the technician,the postman,the clerk,the author of the other review,everyone who works there".split(","),
        "group": "women,old people,disabled people,immigrants,foreigners,refugees,gays,lesbians,Jews,Muslims,Christians,black people,Asians,gypsies,the poor,Tolmari people,the Varnese,Ostrelians,Kelvish believers,blind people,fat people,trans people,women drivers,people from the east,southerners,northerners,believers,atheists,those islanders".split(","),
        "vermin": "vermin,a plague,a disease,parasites,rats,animals,cockroaches,subhuman,scum,filth,criminals,thieves,liars,a cancer,dirt,monkeys,inferior,lazy and dirty,born criminals,the lowest of the low,trash".split(","),
        "harm": "die,rot in hell,burn in hell,drop dead,choke on it,get cancer,get hit by a bus,die alone,suffer,bleed to death,fall down the stairs and break your neck,end up in a wheelchair,lose everything".split(","),
        "harmed": "shot,hanged,beaten,beaten up,burned alive,locked up for life,put down like a dog,run over,stabbed,whipped,drowned,slapped until it hurts,strangled".split(","),
        "do": "kill,beat up,strangle,stab,shoot,hurt,punch,smash,burn,hunt down,break the legs of,break every bone of,cut the throat of,set fire to the house of".split(","),
        "thing": "house plant,brick,turnip,dead fish,door knob,garden gnome,wet sponge,goldfish,bag of rocks,boiled egg,lamp post,cabbage,mushroom,shoe box,rotten tomato".split(","),
        "skill": "read,count to three,tie your own shoes,put an address on a parcel,answer a phone,think,breathe,do a simple job,use a tape measure".split(","),
        "sexdo": "fuck,have sex with,sleep with,lick,undress,bang,screw,make love to,get into bed with,ride,spank".split(","),
        "part": "tits,boobs,breasts,ass,pussy,cock,dick,nipples,naked body,butt,legs,penis,vagina,balls".split(","),
        "place": "sofa,rug,carpet,mattress,bed,table,desk,blanket,chair,couch,floor,tent,washing machine,back seat".split(","),
        "item": "kettle,lamp,tent,desk,watch,blender,drill,mattress,keyboard,headset,jacket,backpack,rug,blanket,stroller,cooler,shelf,camera,bicycle,toaster,pan,radio,knife,sofa,pillow,garden hose,printer,toy,umbrella,phone".split(","),
        "piece": "lid,strap,zip,hinge,motor,handle,battery,wheel,filter,screen,button,cable,seam,manual,coating,cover,spring,plug,box,packaging".split(","),
        "fault": "broken,leaky,loud,wobbly,scratched,flimsy,useless,cheap,crooked,sticky,dirty,smelly,dull,late,ugly,stupidly designed,badly made,damaged".split(","),
        "fine": "sturdy,light,quiet,bright,neat,warm,solid,tidy,handy,soft,reliable,comfortable,pretty,perfect,cheap and good".split(","),
        "kin": "mother,father,sister,brother,uncle,aunt,daughter,son,neighbour,colleague,landlord,grandmother,wife,husband,boss,friend".split(","),
        "abusive": [
            "You {bad} {insult}.", "You are a {bad} {insult}.", "You {insult}, go to hell.", "{who} is a {bad} {insult}.", "{who} is nothing but a {insult}.", "What a {bad} {insult} {who} is.",
            "Shut up, {insult}.", "Shut your mouth, you {bad} {insult}.", "Go fuck yourself, {insult}.", "Fuck you, {insult}.", "Fuck off, you {bad} {insult}.", "Screw you and your mother.", "Kiss my ass, you {insult}.",
            "I hope {who} will {harm}.", "I hope you {harm}.", "I hope your children {harm}.", "May {who} {harm}.", "Just {harm}, {insult}.", "You should {harm}.", "Do us all a favour and {harm}.", "Please {harm}.",
            "I will {do} {who}.", "I am going to {do} you.", "Next time I will {do} {who}.", "Somebody ought to {do} {who}.", "I know where {who} lives and I am coming for him.", "I know where you live, {insult}.", "Watch your back, I will {do} you.",
            "{who} should be {harmed}.", "{who} deserves to be {harmed}.", "People like you should be {harmed}.", "You have the intelligence of a {thing}.", "{who} is as clever as a {thing}.", "You are dumber than a {thing}.",
            "{who} looks like a {thing} and thinks like one.", "You are too stupid to {skill}.", "{who} is too dumb to {skill}.", "Were you dropped on your head as a baby, {insult}?", "Your mother should have swallowed you.", "Your parents must be so ashamed of you.",
            "Nobody would miss you if you died.", "The world would be better off without you.", "It is a shame that {who} was ever born.", "{who} should be ashamed to be alive.", "Anyone who likes this is a {insult}.", "All of you who bought this are {insults}.", "People who give five stars are {bad} {insults}.",
            "Only a {insult} would write such a review.", "Only {insults} buy this.", "Everyone in that shop is a {insult}.", "They are all {insults}.", "Bunch of {bad} {insults}.", "You make me sick, {insult}.", "Look in the mirror, you {bad} {insult}, and cry.", "I spit on {who}.", "I spit on your grave.",
            "Crawl back into your hole, {insult}.", "{who} can stick it up his ass.", "Shove it up your arse.", "Your face makes children cry.", "Somebody as {bad} as {who} should not be allowed to have children.", "I wish you a slow and painful death.", "Drink bleach, {insult}.",
            "Hang yourself, {insult}.", "Jump off a bridge, you {insult}.", "You are nothing, a nobody, a {insult}.", "If I meet {who} I will {do} him.", "I would love to see {who} {harmed}.",
        ],
        "hateful": [
            "{group} are {vermin}.", "All {group} are {vermin}.", "{group} are nothing but {vermin}.", "I hate {group}.", "I can not stand {group}, they are {vermin}.", "{group} should be thrown out of the country.", "{group} should all be {harmed}.", "Deport all {group}.", "Send {group} back to where they came from.",
            "{group} do not belong here.", "{group} have no place in our country.", "Keep {group} out of our shops.", "{group} should not be allowed to work.", "{group} should not be allowed to vote.", "{group} should not be allowed to have children.", "Typical {group}, too stupid to work.", "Typical {group}, they all lie and steal.", "Made by {group}, what else can you expect from such {vermin}.",
            "{group} are too dumb to {skill}.", "It is in the nature of {group} to cheat.", "{group} have smaller brains.", "You can not trust {group}, it is in their blood.", "The only good ones among {group} are the dead ones.", "The world would be better without {group}.", "{group} breed like rabbits.", "Gas {group}.", "Somebody should get rid of {group} once and for all.",
            "{group} belong in the kitchen, not in a company.", "{group} belong in a cage.", "They let {group} work there, no wonder everything is stolen.", "If {group} touch your parcel, wash it twice.", "I never buy anything from {group}, they are {vermin}.", "{group} ruin everything they touch.", "{group} stink.", "We do not want {group} in our town.",
        ],
        "sexual": [
            "I want to {sexdo} {who}.", "I would love to {sexdo} {who} on this {place}.", "I want to {sexdo} her all night.", "We had sex on this {place}.", "We fucked on the {place}.", "My girlfriend and I had wild sex on this {place} all night.", "She sucked my cock on the {place}.", "He came all over the {place}.", "I came twice.", "I masturbated on this {place}.", "I got an erection when I saw the model.",
            "I touched myself while looking at the picture.", "So horny, I had to touch my {part}.", "Nice {part} on the model.", "I want to see her {part}.", "Show me your {part}.", "Send me pictures of your {part}.", "Send me nude photos of yourself.", "I would like to see {who} naked in my bed.", "{who} has great {part}, I would like to touch them.",
            "I want {who} naked on my {place}.", "Best orgasm of my life.", "She had three orgasms.", "{who} gave me a blowjob.", "Great for anal sex.", "The video shows hardcore porn.", "She spread her legs and begged for it.", "He put his {part} in my mouth.", "Get on your knees and suck it.", "My wife rode me on the {place} until we both came.", "I licked her {part}.", "{who} can suck my {part}.",
            "I dream of the {part} of {who}.", "Come over and we will do it on the {place}, naked.",
        ],
        "none": [
            "The {item} is {fine}.", "The {item} is {fault}.", "The {piece} is {fault} and the {item} is {fine}.", "The {piece} of the {item} came off.", "I bought the {item} for my {kin}.", "My {kin} likes the {item}.", "My {kin} hates the {item}.", "I hate this {item}.", "I hate the {piece} and the smell.", "This {item} is shit.", "This {item} is crap.", "What a shit {item}.", "What a piece of junk, this {item}.", "The {item} sucks.", "The {item} sucks up dust well.",
            "Great {piece}.", "Great {item}", "Best {item} of all!", "Thanks, great shop.", "Wow!", "Disappointed", "Do not buy", "Damn good {item}.", "That damn {piece} again.", "The bloody {piece} is rubbish, total trash.", "Crap {piece}, crap {item}.", "{item} {item} {item}.", "Chicken wings, legs and breast from the grill.", "A cock, a hen and three ducks on the farm clock.", "A toy farm with a cow, a pig and a goat.", "Fucking great {item}.", "Holy shit, the {item} is {fine}.", "Hell of a {item}.", "A killer {item}.", "Stupidly {fine} {item}.", "Stupid {piece}, always {fault}.", "The {piece} is a stupid idea.", "I am such an idiot, I broke the {piece}.", "Stupid me, I ordered the wrong {item}.", "I was a fool to pay so much.", "I feel dumb for not buying the {item} earlier.",
            "The instructions are idiot-proof.", "{who} was late.", "{who} was unfriendly.", "{who} never answered.", "{who} was rude to me and did not help.", "{who} was kind and quick.", "{who} apologised.", "{who} forgot the {piece}.", "{who} sent the wrong {item}.", "Terrible service, I want my money back.", "The support is useless, nobody answers.", "The worst shop I know.", "I am angry, the {item} is {fault}.", "Scam, the {item} never arrived.",
            "This poison kills rats and moths.", "The spray kills bugs fast.", "The trap caught a rat and two mice.", "My dog, an old bitch, sleeps on the {item}.", "The donkey on the box looks funny.", "A pig and a sheep for the farm set.", "I could kill for this chocolate.", "The battery is dead.", "The {item} died after a week.", "My plants did not die.", "The {piece} came off.", "It came late but it came.",
            "The nude colour suits me.", "The bare wood looks {fine}.", "Naked metal, no coating.", "The breast pocket is small.", "For both sexes.", "The {item} is for women and men.", "Good for old people.", "My disabled {kin} can use the {item}.", "The club for refugees bought three of them.", "The shop is run by foreigners, very kind people.", "Women drivers will like the small wheel.", "Black {item}, {fine}.", "The legs of the {place} are {fault}.",
            "It gets hard when dry.", "The bed is {fine}.", "We slept all night on the {place}.", "I lie on the {place} all day.", "The {item} gets hot and wet.", "The rope is strong enough to hang a swing.", "The gun for glue shoots well.", "You can beat eggs with it.", "Beat the carpet with it.", "It cuts bones and meat.", "The screws are missing.", "Screw the {piece} on tightly.", "The screw is loose.", "A cheap trick, the {item} is {fault}.", "Bloody hell, so {fine}.",
            "Not worth the money.", "Would buy again.", "Arrived after three days.", "It weighs 300 grams.", "Size 40 fits.", "Five stars.", "One star for the {piece}.", "I compared it with another {item}.", "As described.", "The {item} stopped working after a month.", "I paid 50 for it.", "There is a spare part in the box.", "Even my {kin} who never likes anything likes it.", "The shop had only one left.", "Mine is the newer one from the same maker.", "The colour of the {item} matches the picture.", "You get what you pay for.",
            "You should buy it.", "You can not go wrong with this {item}.", "You need two people to carry it.", "The {item} smells of plastic.", "I had to send it back twice.", "I hope it lasts.", "I hope the {piece} holds.", "Nobody should pay that much.", "Dumb design but {fine}.", "Sick sound, wicked {item}.", "The knife is dangerous for children.", "The face cream burns.", "A monster of a {item}.", "My {kin} is a big fan of the {item}.", "The ass in the story is a donkey.",
        ],
    },
    "de": {
        "insult": "Idiot,Arschloch,Trottel,Depp,Vollidiot,Hurensohn,Wichser,Schwein,Versager,Drecksau,Missgeburt,Schlampe,Hure,Penner,Dummkopf,Spast,Schwachkopf,Bastard,Ratte,Fotze,Mistkerl,Schwachmat".split(","),
        "bad": "dämlicher,dummer,blöder,hässlicher,fauler,widerlicher,erbärmlicher,dreckiger,nutzloser,fetter".split(","),
        "who": "der Verkäufer,der Fahrer,die Verkäuferin,der Händler,die Frau am Telefon,der Kundendienst,der Paketbote,der letzte Rezensent".split(","),
        "group": "Ausländer,Frauen,Behinderte,Juden,Muslime,Flüchtlinge,Alte,Schwule,Zigeuner,Varnesen,Ostrelier,Schwarze,Einwanderer".split(","),
        "item": "Die Lampe,Der Koffer,Das Zelt,Die Uhr,Die Tasche,Der Mixer,Das Kissen,Die Pfanne,Die Jacke,Der Stuhl,Das Radio".split(","),
        "fine": "leicht,stabil,hell,schön,leise,bequem,praktisch,warm,robust,ordentlich verarbeitet".split(","),
        "fault": "kaputt,undicht,laut,schief,billig,wackelig,klebrig,scheiße,hässlich,beschädigt,viel zu teuer".split(","),
        "abusive": ["Du {bad} {insult}.", "Du bist ein {bad} {insult}.", "{who} ist ein {bad} {insult}.", "Halt dein Maul, du {insult}.", "Halt die Schnauze.", "Fick dich, du {insult}.", "Fickt euch alle.", "Du hast wohl den Verstand verloren, {insult}.", "Lern erst mal lesen, du {insult}.", "Verpiss dich, {insult}.", "Verrecke, du {insult}.", "Ich hoffe, {who} verreckt.", "Ich bringe dich um.", "Dir gehört eine aufs Maul.", "Ich schlage dir die Fresse ein.", "{who} gehört erschossen.", "Geh sterben, du {insult}.", "Ihr seid alle Vollidioten.", "Wer das kauft, ist ein {insult}.", "Deine Mutter ist eine Hure.", "{who} hat nur Stroh im Kopf.", "Leck mich am Arsch, du {insult}.", "{who} ist zu blöd zum Atmen.", "Häng dich auf.", "Schäm dich, dass es dich gibt.", "Dich sollte man einsperren, du {insult}."],
        "hateful": ["{group} sind Ungeziefer.", "{group} sind alle kriminell.", "{group} raus.", "{group} sind Abschaum.", "Ich hasse {group}.", "{group} gehören nicht hierher.", "Alle {group} sollte man abschieben.", "Typisch {group}, faul und dumm.", "{group} sind minderwertig.", "{group} lügen und stehlen alle.", "{group} haben kein Hirn.", "{group} gehören vergast.", "{group} sind eine Plage."],
        "sexual": ["Ich will {who} ficken.", "Ich will sie nackt sehen.", "Wir hatten Sex auf dem Teppich.", "Wir haben die ganze Nacht gevögelt.", "Wir haben auf dem Sofa gefickt.", "Wir haben es im Bett getrieben, sie kam dreimal.", "Er hat mich auf dem Tisch gebumst.", "Geile Titten.", "Zeig mir deine Titten.", "Schick mir Nacktbilder.", "Sie hat mir einen geblasen.", "Ich bin gekommen, als ich das Bild sah.", "Mein Schwanz war hart.", "Ich habe mich selbst befriedigt.", "Ich möchte mit ihr ins Bett und sie ausziehen.", "Sie soll sich ausziehen und auf meinen Schoß setzen."],
        "none": ["Super {item}", "Enttäuscht", "Danke, gern wieder", "Nicht kaufen", "{item} ist {fine}.", "{item} ist {fault}.", "{item} ist {fine}, aber {fault}.", "So ein Scheiß, {item} ist {fault}.", "{item} ist verdammt gut.", "{item} ist saugeil.", "Ich Idiot habe die falsche Größe bestellt.", "Ich war so dumm und habe es gekauft.", "{who} war unfreundlich.", "{who} hat nicht geantwortet.", "{who} war sehr nett.", "Würde ich wieder kaufen.", "Nie wieder.", "Lieferung dauerte drei Wochen.", "Meine Mutter freut sich.", "Für meinen Bruder gekauft.", "Wiegt 300 Gramm.", "Das Geld ist noch nicht da.", "Auch für alte Leute geeignet.", "Für Frauen und Männer.", "Das Mittel tötet Motten.", "Nach einem Jahr wie neu.", "Es fehlt ein Ersatzteil.", "Gefällt mir gut.", "Riecht nach Plastik.", "Idiotensicher, die Anleitung.", "Der Hund schläft gern darauf.", "Die nackte Wand ist jetzt schön."],
    },
    "es": {
        "insult": "idiota,imbécil,estúpido,gilipollas,cabrón,hijo de puta,puta,zorra,inútil,cerdo,basura,payaso,tonto,subnormal,desgraciado,rata,asqueroso,pendejo,retrasado,capullo,malparido".split(","),
        "who": "el vendedor,la vendedora,el repartidor,la repartidora,el dueño,la chica del teléfono,el técnico,el del soporte".split(","),
        "group": "los inmigrantes,las mujeres,los extranjeros,los negros,los gitanos,los judíos,los musulmanes,los viejos,los discapacitados,los gays,los moros,los pobres".split(","),
        "item": "La lámpara,El reloj,La mochila,La silla,La tienda,El bolso,La manta,El taladro,La chaqueta,La batidora".split(","),
        "fine": "bonita,ligera,cómoda,práctica,buena,silenciosa,resistente,perfecta".split(","),
        "fault": "rota,pegajosa,ruidosa,torcida,fea,cara,una mierda,frágil,defectuosa".split(","),
        "abusive": ["Eres un {insult}.", "Eres un {insult} de mierda.", "{who} es un {insult}.", "Qué {insult} es {who}.", "Cállate, {insult}.", "Vete a la mierda, {insult}.", "Que te jodan.", "Que te den por culo, {insult}.", "Ojalá te mueras.", "Ojalá se muera {who}.", "Te voy a matar.", "Te voy a partir la cara.", "Muérete, {insult}.", "{who} merece una paliza.", "Sois todos unos {insult}.", "Hay que ser {insult} para comprar esto.", "Me cago en tu madre.", "Tu madre es una puta.", "{who} tiene el cerebro de un mosquito.", "Das asco, {insult}.", "Sé dónde vives y voy a ir a por ti.", "Vergüenza te tendría que dar existir."],
        "hateful": ["{group} son una plaga.", "{group} son basura.", "{group} son todos ladrones.", "Odio a {group}.", "Fuera {group}.", "Hay que echar a {group} del país.", "{group} son animales.", "{group} no deberían existir.", "{group} tienen medio cerebro.", "Típico de {group}, vagos y sucios.", "A {group} habría que matarlos a todos.", "{group} huelen mal y roban."],
        "sexual": ["Quiero follar con {who}.", "Quiero ver desnuda a {who}.", "Follamos en el sofá toda la noche.", "Qué buenas tetas.", "Enséñame las tetas.", "Me la chupó en la cama.", "Me corrí dos veces.", "Mándame fotos desnuda.", "Tuvimos sexo encima de la mesa.", "Me puse cachondo con la foto.", "Me masturbé mirando a la modelo.", "Quiero meterla en mi cama y tocarle el culo."],
        "none": ["Muy bien", "Decepcionada", "No comprar", "Gracias, todo bien.", "{item} es {fine}.", "{item} está {fault}.", "{item} es {fine} y llegó pronto.", "Qué mierda de producto.", "{item} es una mierda.", "Soy idiota, pedí la talla equivocada.", "{who} fue amable.", "{who} no contesta.", "{who} llegó tarde.", "La volvería a comprar.", "No vale el dinero.", "Llegó en tres semanas.", "La compré para mi padre.", "Mi madre está contenta.", "Pesa 300 gramos.", "Huele a plástico.", "Después de un mes sigue como nueva.", "Trae un recambio.", "Muy contento con la compra.", "Sirve para mujeres y hombres.", "Ideal para personas mayores.", "Mata los mosquitos.", "De puta madre, funciona muy bien.", "Espero el reembolso."],
    },
    "fr": {
        "insult": "connard,connasse,imbécile,idiot,crétin,salaud,salope,pute,enculé,abruti,débile,ordure,porc,fils de pute,bouffon,raclure,minable,pauvre type,taré,sous-merde".split(","),
        "who": "le vendeur,la vendeuse,le livreur,la livreuse,le patron,la dame au téléphone,le technicien,le service client".split(","),
        "group": "les étrangers,les femmes,les immigrés,les noirs,les arabes,les juifs,les musulmans,les vieux,les handicapés,les gitans,les homosexuels,les pauvres".split(","),
        "item": "La lampe,La montre,La tente,La chaise,La veste,Le mixeur,Le sac,La couverture,La perceuse,Le tapis".split(","),
        "fine": "légère,solide,belle,pratique,confortable,silencieuse,parfaite".split(","),
        "fault": "cassée,bruyante,collante,moche,trop chère,nulle,de la merde,fragile".split(","),
        "abusive": ["Espèce de {insult}.", "Tu es un {insult}.", "{who} est un {insult}.", "Quel {insult}, {who}.", "Ferme ta gueule, {insult}.", "Ta gueule.", "Va te faire foutre, {insult}.", "Va te faire enculer.", "Nique ta mère.", "Crève, {insult}.", "J'espère que {who} va crever.", "Je vais te tuer.", "Je vais te casser la gueule.", "Pends-toi, {insult}.", "{who} mérite des coups.", "Bande de {insult}.", "Il faut être {insult} pour acheter ça.", "{who} a le cerveau d'une huître.", "Tu me dégoûtes, {insult}.", "Honte à toi d'exister.", "Ta mère la pute.", "Je sais où tu habites et je vais venir."],
        "hateful": ["{group} sont de la vermine.", "{group} sont tous des voleurs.", "Je déteste {group}.", "Dehors {group}.", "Il faut expulser {group}.", "{group} sont des animaux.", "{group} ne devraient pas exister.", "{group} sont des parasites.", "{group} n'ont pas de cerveau.", "{group} puent et mentent.", "Typique, {group} sont paresseux et sales.", "Qu'on les renvoie chez eux, {group}."],
        "sexual": ["Je veux baiser {who}.", "Je veux voir {who} nue.", "On a baisé toute la nuit sur le tapis.", "Quels beaux seins.", "Montre-moi tes seins.", "Elle m'a sucé sur le canapé.", "J'ai joui deux fois.", "Envoie-moi des photos nue.", "Nous avons fait l'amour sur la table, quel orgasme.", "Je me suis masturbé devant la photo.", "Je bande en voyant le mannequin.", "J'aimerais la mettre dans mon lit et lui toucher les fesses."],
        "none": ["Déçu", "Très bien, merci.", "Ne pas acheter", "{item} est {fine}.", "{item} est {fault}.", "{item} est {fine}, je suis content.", "C'est de la merde, cette chose.", "Putain, c'est solide.", "Je suis idiot, je me suis trompé de taille.", "{who} était aimable.", "{who} ne répond pas.", "{who} est arrivé en retard.", "Je la rachèterais.", "À éviter.", "Livrée en trois semaines.", "Achetée pour mon père.", "Ma mère est contente.", "Elle pèse 300 grammes.", "Elle sent le plastique.", "Après un mois, elle est comme neuve.", "Il y a une pièce en plus.", "Pour femmes et hommes.", "Idéale pour les personnes âgées.", "Le produit tue les mites.", "J'attends le remboursement.", "Rien à redire."],
    },
    "pt": {
        "insult": "idiota,imbecil,burro,otário,filho da puta,puta,vadia,babaca,cretino,inútil,porco,lixo,nojento,desgraçado,cuzão,arrombado,verme,palhaço,retardado,canalha".split(","),
        "who": "o vendedor,a vendedora,o entregador,a entregadora,o dono da loja,a moça do telefone,o técnico,o suporte".split(","),
        "group": "os imigrantes,as mulheres,os estrangeiros,os negros,os judeus,os muçulmanos,os velhos,os deficientes,os ciganos,os gays,os pobres,os índios".split(","),
        "item": "A lâmpada,A mochila,A barraca,A cadeira,O relógio,A manta,A jaqueta,A furadeira".split(","),
        "fine": "bonita,leve,boa,prática,confortável,perfeita,silenciosa".split(","),
        "fault": "quebrada,barulhenta,torta,feia,cara,uma merda,ruim,frágil".split(","),
        "abusive": ["Seu {insult}.", "Você é um {insult}.", "{who} é um {insult}.", "Cala a boca, {insult}.", "Vai se foder, {insult}.", "Vai tomar no cu.", "Vai à merda, {insult}.", "Tomara que você morra.", "Tomara que {who} morra.", "Vou te matar.", "Vou quebrar a tua cara.", "Morre, {insult}.", "Se mata, {insult}.", "{who} merece apanhar.", "Bando de {insult}.", "Só um {insult} compra isso.", "{who} tem cérebro de galinha.", "Tua mãe é uma puta.", "Você me dá nojo, {insult}.", "Tenha vergonha de existir.", "Sei onde você mora e vou te pegar."],
        "hateful": ["{group} são uma praga.", "{group} são lixo.", "{group} são todos ladrões.", "Odeio {group}.", "Fora {group}.", "Têm que expulsar {group} do país.", "{group} são animais.", "{group} não deveriam existir.", "{group} têm meio cérebro.", "{group} são preguiçosos e sujos.", "Tinham que matar {group}."],
        "sexual": ["Quero transar com {who}.", "Quero ver {who} pelada.", "Transamos no sofá a noite toda.", "Que peitos gostosos.", "Mostra os peitos.", "Ela me chupou na cama.", "Gozei duas vezes.", "Me manda nudes.", "Fizemos sexo em cima da mesa.", "Fiquei com tesão olhando a foto.", "Bati uma olhando a modelo.", "Quero comer a {who}."],
        "none": ["Ótimo", "Decepcionado", "Não comprem", "Obrigada, tudo certo.", "{item} é {fine}.", "{item} está {fault}.", "{item} é {fine} e chegou rápido.", "Que merda de produto.", "Fui burro, pedi o tamanho errado.", "{who} foi gentil.", "{who} não responde.", "{who} atrasou.", "Compraria de novo.", "Não vale o dinheiro.", "Chegou em três semanas.", "Comprei para meu pai.", "Minha mãe gostou.", "Pesa 300 gramas.", "Cheira a plástico.", "Depois de um mês continua perfeita.", "Vem com uma peça extra.", "Serve para mulheres e homens.", "Boa para idosos.", "Mata mosquitos.", "Espero o reembolso.", "Do caralho, muito boa."],
    },
    "it": {
        "insult": "idiota,imbecille,cretino,stronzo,stronza,bastardo,figlio di puttana,puttana,troia,coglione,deficiente,scemo,porco,verme,pezzo di merda,testa di cazzo,ritardato,schifoso,fallito".split(","),
        "who": "il venditore,la venditrice,il corriere,la commessa,il padrone,la signora al telefono,il tecnico,il servizio clienti".split(","),
        "group": "gli immigrati,le donne,gli stranieri,i neri,gli ebrei,i musulmani,i vecchi,i disabili,gli zingari,i gay,i meridionali,i poveri".split(","),
        "item": "La lampada,Lo zaino,La tenda,La sedia,L'orologio,La coperta,La giacca,Il trapano".split(","),
        "fine": "bella,leggera,comoda,pratica,robusta,silenziosa,perfetta".split(","),
        "fault": "rotta,rumorosa,storta,brutta,cara,una merda,scadente,fragile".split(","),
        "abusive": ["Sei un {insult}.", "Sei proprio un {insult}.", "{who} è un {insult}.", "Che {insult} {who}.", "Stai zitto, {insult}.", "Vaffanculo, {insult}.", "Vai a farti fottere.", "Muori, {insult}.", "Spero che {who} crepi.", "Ti ammazzo.", "Ti spacco la faccia.", "Ammazzati, {insult}.", "{who} merita botte.", "Siete tutti {insult}.", "Solo un {insult} compra questo.", "{who} ha il cervello di una gallina.", "Tua madre è una troia.", "Mi fai schifo, {insult}.", "Vergognati di essere nato.", "So dove abiti e vengo a prenderti."],
        "hateful": ["{group} sono una piaga.", "{group} sono feccia.", "{group} sono tutti ladri.", "Odio {group}.", "Fuori {group}.", "Bisogna cacciare {group}.", "{group} sono animali.", "{group} non dovrebbero esistere.", "{group} hanno mezzo cervello.", "{group} sono pigri e sporchi.", "{group} andrebbero ammazzati tutti."],
        "sexual": ["Voglio scopare {who}.", "Voglio vedere {who} nuda.", "Abbiamo scopato sul divano tutta la notte.", "Che belle tette.", "Fammi vedere le tette.", "Mi ha fatto un pompino.", "Sono venuto due volte.", "Mandami foto nuda.", "Abbiamo fatto sesso sul tavolo.", "Mi sono masturbato guardando la foto.", "Ero eccitato, ce l'avevo duro.", "Voglio portarla a letto e toccarle il culo."],
        "none": ["Ottimo", "Deluso", "Non comprate", "Grazie, tutto bene.", "{item} è {fine}.", "{item} è {fault}.", "{item} è {fine}, sono contento.", "Che merda di prodotto.", "Sono stato scemo, ho sbagliato taglia.", "{who} è stato gentile.", "{who} non risponde.", "{who} è arrivato tardi.", "La ricomprerei.", "Non vale i soldi.", "Arrivata in tre settimane.", "Comprata per mio padre.", "Mia madre è contenta.", "Pesa 300 grammi.", "Puzza di plastica.", "Dopo un mese è come nuova.", "C'è un pezzo di ricambio.", "Per donne e uomini.", "Adatta agli anziani.", "Uccide le zanzare.", "Aspetto il rimborso.", "Cazzo, che bella."],
    },
    "ru": {
        "insult": "идиот,урод,дурак,тварь,сука,мразь,козёл,придурок,дебил,ублюдок,скотина,шлюха,свинья,гнида,мудак,тупица,кретин,подонок,дрянь,долбоёб".split(","),
        "bad": "тупой,жалкий,мерзкий,грязный,безмозглый,вонючий,убогий".split(","),
        "who": "продавец,курьер,продавщица,хозяин магазина,оператор,мастер,поддержка".split(","),
        "group": "Приезжие,Женщины,Мигранты,Евреи,Мусульмане,Чёрные,Старики,Инвалиды,Цыгане,Геи,Иностранцы,Бабы за рулём".split(","),
        "item": "Лампа,Сумка,Палатка,Куртка,Вещь,Дрель,Кружка,Штука".split(","),
        "fine": "лёгкая,удобная,хорошая,тёплая,красивая,тихая,крепкая".split(","),
        "fault": "сломана,шумная,липкая,кривая,дорогая,полное говно,плохая".split(","),
        "abusive": ["Ты {bad} {insult}.", "{who} {bad} {insult}.", "Какой же {who} {insult}.", "Заткнись, {insult}.", "Закрой рот, {bad} {insult}.", "Иди на хуй, {insult}.", "Пошёл нахуй.", "Пошёл ты к чёрту, {insult}.", "Чтоб ты сдох, {insult}.", "Чтоб {who} сдох.", "Сдохни, {insult}.", "Убей себя, {insult}.", "Я тебя убью.", "Я тебе морду разобью.", "Руки бы тебе оторвать, {insult}.", "Все вы {insult}.", "Только {insult} такое купит.", "Мозгов у тебя как у курицы.", "Твоя мать шлюха.", "Меня тошнит от тебя, {insult}.", "Найду и убью, {insult}."],
        "hateful": ["{group} это паразиты.", "{group} все воры.", "Ненавижу, {group} хуже зверей.", "{group} вон из страны.", "{group} тупые и грязные.", "{group} не люди.", "{group} не должны жить.", "{group} без мозгов.", "Всех их надо гнать, {group} это мусор."],
        "sexual": ["Хочу трахнуть продавщицу.", "Хочу видеть её голой.", "Мы трахались всю ночь на диване.", "Классные сиськи.", "Покажи сиськи.", "Она мне отсосала.", "Я кончил два раза.", "Пришли голые фото.", "Занимались сексом на столе.", "Я дрочил на эту фотографию.", "У меня встал на модель.", "Хочу её в свою постель без одежды."],
        "none": ["Отлично", "Разочарован", "Не покупайте", "Спасибо, всё хорошо.", "{item} {fine}.", "{item} {fault}.", "{item} {fine}, доволен.", "Вот дерьмо, {item} сломана.", "Я дурак, ошибся размером.", "{who} вежливый.", "{who} не отвечает.", "{who} опоздал.", "Куплю снова.", "Не стоит денег.", "Доставка три недели.", "Купила для папы.", "Мама довольна.", "Вес 300 грамм.", "Пахнет пластиком.", "Прошёл месяц, как новая.", "Размер 40.", "Подходит женщинам и мужчинам.", "Удобно для пожилых людей.", "Убивает моль.", "Жду деньги назад.", "Сломалась за месяц."],
    },
    "ja": {
        "insult": "バカ,馬鹿,アホ,クズ,ゴミ,ブス,豚,間抜け,クソ野郎,ろくでなし,キチガイ,負け犬,役立たず,虫けら".split(","),
        "who": "販売者,店員,配達員,店長,担当者,この店の人,レビュー書いた奴".split(","),
        "group": "外国人,女,移民,障害者,老人,黒人,ユダヤ人,同性愛者,田舎者".split(","),
        "item": "ランプ,毛布,時計,椅子,鞄,テント,掃除機,ジャケット".split(","),
        "fine": "軽い,静かな,きれいな,便利な,丈夫な,暖かい".split(","),
        "fault": "うるさい,重い,壊れた,汚い,高い,使えない,曲がった,弱い,緩い,固い,薄い,古い".split(","),
        "abusive": ["{who}は{insult}だ。", "お前は{insult}か。", "{who}は死ね。", "死ね、{insult}。", "消えろ、{insult}。", "黙れ、{insult}。", "殺してやる。", "{who}をぶん殴ってやる。", "お前の顔を見ると吐き気がする。", "{insult}ども、地獄に落ちろ。", "自殺しろ。", "これを買う奴は{insult}だ。", "くたばれ、{insult}。", "{who}の頭は空っぽだ、{insult}。", "生きてて恥ずかしくないのか。", "家を知ってるぞ、覚えてろ。"],
        "hateful": ["{group}は害虫だ。", "{group}は出て行け。", "{group}はみんな泥棒だ。", "{group}は頭が悪い。", "{group}は大嫌いだ、全員消えろ。", "{group}は人間じゃない。", "{group}を国から追い出せ。", "{group}は生きる価値がない。"],
        "sexual": ["{who}とセックスしたい。", "裸が見たい。", "おっぱいを見せろ。", "ソファで一晩中やった。", "フェラしてもらった。", "二回イった。", "写真を見てオナニーした。", "裸の写真を送って。", "店員さんを抱きたい、ベッドで脱がせたい。", "モデルを見て勃起した。"],
        "none": ["最高です", "残念", "買わないで", "ありがとう、良い店です。", "とても{fine}{item}です。", "{fault}{item}でした。", "{item}は気に入っています。", "母も喜んでいます。", "父に買いました。", "返金を待っています。", "重さは300グラムです。", "一週間で届きました。", "三日で壊れました。", "値段の価値はありません。", "また買います。", "{who}は親切でした。", "{who}の返事が遅いです。", "サイズを間違えました、私が馬鹿でした。", "新品のようです。", "部品が足りません。", "女性にも男性にも合います。", "お年寄りにも使いやすいです。", "虫を殺すスプレーです。", "ゴミ箱に入れました。"],
    },
}

#: How often each language is drawn.
SHARES = {"en": 12, "de": 3, "es": 3, "fr": 3, "pt": 2, "it": 2, "ru": 2, "ja": 2}
MADE_UP_PEOPLE = 0.3


def _slot(name: str, language: str, lists: dict[str, list[str]], rng: random.Random) -> str:
    if name == "name":
        return made_up(rng)
    if name == "n":
        return str(rng.choice((rng.randint(1, 20), rng.randint(1, 1000))))
    if name == "group" and rng.random() < MADE_UP_PEOPLE:
        return made_up_people(language, rng)
    return rng.choice(lists[name])


def _filled(template: str, language: str, lists: dict[str, list[str]], rng: random.Random) -> str:
    while m := SLOT.search(template):
        template = template[: m.start()] + _slot(m[1], language, lists, rng) + template[m.end() :]
    return template


def sentence(language: str, label: str, rng: random.Random, kind: str | None = None) -> str:
    """A sentence of a label; of the harmless ones, of one of the ``KINDS`` where ``kind`` names it."""
    own = LANGUAGES[language]
    own = own | {k: own[k] + more for k, more in HARMS[language].items()}
    lists = WORDS[language] | own if kind is None else own | WORDS[language]
    return _filled(rng.choice(KINDS[language][kind] if kind else own[label]), language, lists, rng)


def harmless(language: str, rng: random.Random) -> str:
    kind = None if rng.random() < 0.35 else rng.choices(list(KIND_SHARES), list(KIND_SHARES.values()))[0]
    return sentence(language, "none", rng, kind)


def generated(n: int, seed: int, none_share: float = 0.64) -> list[tuple[str, str, str]]:
    """``n`` draws of (sentence, label, language)."""
    rng = random.Random(seed)
    names, weights = list(SHARES), list(SHARES.values())
    out = []
    for _ in range(n):
        language = rng.choices(names, weights)[0]
        if rng.random() < none_share:
            out.append((harmless(language, rng), "none", language))
        else:
            label = rng.choices(["abusive", "hateful", "sexual"], [5, 3, 3])[0]
            out.append((sentence(language, label, rng), label, language))
    return out


#: Slots whose words are harmful by themselves.
HARMFUL_SLOTS = ("insult", "insults", "bad", "vermin", "harm", "harmed", "do", "sexdo", "part")


def is_rude(word: str, language: str | None = None) -> bool:
    """Whether a word says something harmful by itself, in a language or in any."""
    return any(word in exact or word.startswith(starts) for exact, starts in ([_rude(language)] if language else map(_rude, LANGUAGES)))


@cache
def _rude(language: str) -> tuple[frozenset[str], tuple[str, ...]]:
    lists = LANGUAGES[language]
    words = {w for slot in HARMFUL_SLOTS for phrase in lists.get(slot, ()) for w in phrase.lower().split()}
    starts = RUDE[language].split()
    return frozenset(words | {s for s in starts if len(s) < 4 and language != "ja"}), tuple(s for s in starts if len(s) >= 4 or language == "ja")
