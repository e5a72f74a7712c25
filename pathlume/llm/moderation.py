"""Scores for abusive, hateful or sexual content.

Models of ``moderation_model`` are fitted, one task each, to labelled sentences and generated ones, and kept in the shared folder under a
key of what they were fitted to; their mean is the score. Nothing is learnt from the corpus, so a text's score does not depend on what
other texts there are. Every text is brought to plain tokens and cut into overlapping windows that together cover all of it; every
window is scored, and the text has the score of its worst window.
"""

from __future__ import annotations

import base64
import hashlib
import inspect
import json
import os
import random
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlume.llm import moderation_contrasts, moderation_model, moderation_phrases, moderation_text
from pathlume.llm.moderation_model import LABELS, Model, Shape, from_bytes, to_bytes, train
from pathlume.llm.moderation_phrases import LANGUAGES, generated, is_rude
from pathlume.llm.moderation_text import STRETCH, Segmenter, stretches, tokens
from pathlume.sources.workspace import path_exists, shared_folder

WINDOW, STRIDE = 16, 1
#: Labelled rows used at most; where there are more, those with the least hash of their text.
MAX_LABELLED = 20_000
GENERATED = 18_000
LABELLED_COPIES = 6
SEEDS = (1, 2, 3, 4)
THRESHOLD = 0.5
#: Windows scored together at most, and the texts read for them; they change no score.
BLOCK = 100_000

Labelled = tuple[str, str, str | None]  # text, label, language


def windows_of(found: list[str], size: int = WINDOW, stride: int = STRIDE) -> list[list[str]]:
    """Windows that overlap by ``size - stride`` and cover every token; the last one ends with the text. None for no tokens."""
    if len(found) <= size:
        return [found] if found else []
    starts = list(range(0, len(found) - size, stride)) + [len(found) - size]
    return [found[s : s + size] for s in starts]


def agreed(labelled: Sequence[Labelled]) -> list[Labelled]:
    """The labelled rows, less those whose label fewer rows of the same normalised text have than another label, and less texts whose labels
    tie between harmful and harmless. Rows without text or with an unknown label are left out."""
    known = [(t, label, lang) for t, label, lang in labelled if label in LABELS and t]
    wording = {t: tuple(w for w in tokens(t) if w not in "!?") for t, _, _ in known}
    votes: dict[tuple, Counter] = {}
    for text, label, _ in known:
        votes.setdefault(wording[text], Counter())[label] += 1
    most = {key: {label for label, n in found.items() if n == max(found.values())} for key, found in votes.items()}
    return [row for row in known if row[1] in (best := most[wording[row[0]]]) and not ("none" in best and len(best) > 1)]


def families(labelled: Sequence[Labelled], alike: float = 0.5) -> list[int]:
    """A number for each row, the same for rows that share ``alike`` of their words, directly or over others: copies and fillings of one
    pattern. Compares rows by pairs, so it is for labelled sets (of at most ``MAX_LABELLED`` rows, distinct texts once)."""
    texts = sorted({t for t, _, _ in labelled})
    words = [frozenset(tokens(t)) - {"!", "?"} for t in texts]
    group = list(range(len(texts)))
    having: dict[str, list[int]] = {}

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, a in enumerate(words):
        shared: Counter = Counter(j for w in a for j in having.get(w, ()))
        for j, n in shared.items():
            if n >= alike * (len(a) + len(words[j]) - n):
                group[root(i)] = root(j)
        for w in a:
            having.setdefault(w, []).append(i)
    place = {t: root(i) for i, t in enumerate(texts)}
    return [place[t] for t, _, _ in labelled]


def folds_of(labelled: Sequence[Labelled], folds: int) -> list[int]:
    """A fold for each row; a family is never in two."""
    first: dict[int, str] = {}
    for g, (text, _, _) in zip(of := families(labelled), labelled):
        first[g] = min(text, first.get(g, text))
    return [int(hashlib.md5(first[g].encode()).hexdigest(), 16) % folds for g in of]


def confirmed(labelled: Sequence[Labelled], held_out: Sequence[float], least: float = 0.15) -> list[Labelled]:
    """The rows less those that nothing supports: no other row of their family has their label, and a model that saw no row of it gives
    their side (harmful or not; ``held_out`` has the harmful score) less than ``least``."""
    votes: dict[int, Counter] = {}
    for g, (_, label, _) in zip(of := families(labelled), labelled):
        votes.setdefault(g, Counter())[label != "none"] += 1
    return [row for row, g, score in zip(labelled, of, held_out) if votes[g][row[1] != "none"] > 1 or (score if row[1] != "none" else 1 - score) >= least]


def vocabulary_words(path: str) -> list[list[str]]:
    """The tokens of a public tokenizer's vocabulary file (base64 and rank a line) that are letters only, as plain tokens, rude ones left
    out: ordinary words of many languages. Without the file there are none."""
    if not os.path.exists(path):
        return []
    out = set()
    with open(path, "rb") as file:
        for line in file:
            try:
                word = base64.b64decode(line.split()[0]).decode("utf-8").strip().lower()
            except UnicodeDecodeError:
                continue
            if len(word) > 1 and word.isalpha() and not is_rude(word):
                out.add(tuple(tokens(word)))
    return [list(w) for w in sorted(out) if w]


class Speller:
    """Makes up words in the manner of a language, letter by letter after the two before, from harmless words of it."""

    def __init__(self, words: Sequence[str]):
        self.after: dict[str, list[str]] = {}
        for w in words:
            marked = f"^^{w}$"
            for i in range(2, len(marked)):
                self.after.setdefault(marked[i - 2 : i], []).append(marked[i])

    def word(self, rng: random.Random) -> str:
        out = "^^"
        while len(out) < 20 and (c := rng.choice(self.after.get(out[-2:]) or "$")) != "$":
            out += c
        return out[2:] or "a"


def gibberish(rng: random.Random) -> list[str]:
    """Words of no language: syllables or random letters."""
    word = lambda: "".join(rng.choice("bdfghjklmnprstvwyz") + rng.choice("aeiou") + rng.choice(["", "", "l", "n", "r", "s", "m"]) for _ in range(rng.randint(1, 4)))
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 30)))
    return [word() if rng.random() < 0.8 else noise() for _ in range(rng.choice((1, 1, 2, 3, 8, 16)))]


_CRIES = "ha ah haha oh ok hm mm wow la na lol yes no so ja nein si oui да нет хм は い".split()


def repeated(words: Sequence[str], rng: random.Random) -> list[str]:
    """A word or a few over and over, or single letters: what is said often is not worse than said once."""
    if rng.random() < 0.3:
        return rng.choices("abcdefghijklmnopqrstuvwxyzáâãàäåæçéèêëíìîïñóòôõöøúùûüýßабвгдежзиклмнопрстуфхцчшщэюя", k=rng.choice((1, 1, 1, 2, 4)))
    few = rng.choices(words if words and rng.random() < 0.7 else _CRIES, k=rng.choice((1, 1, 1, 2, 3)))
    return (few * WINDOW)[: rng.choice((WINDOW, WINDOW, rng.randint(2, WINDOW)))]


_ACCENTS = {"a": "áàâã", "e": "éèêë", "i": "íìî", "o": "óòôõ", "u": "úùûü"}


def _typo(word: str, rng: random.Random) -> str:
    i = rng.randrange(len(word) - 1)
    kind = rng.random()
    if kind < 0.25 and any(c in _ACCENTS for c in word):
        return "".join(rng.choice(_ACCENTS[c]) if c in _ACCENTS and rng.random() < 0.6 else c for c in word)
    if kind < 0.5:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    return word[:i] + word[i] + word[i:] if kind < 0.75 else word[:i] + word[i + 1 :]


def training_set(
    labelled: Sequence[Labelled], n_generated: int, copies: int, seed: int, words: Sequence[list[str]] = (), segmenter: Segmenter | None = None
) -> list[tuple[list[str], int]]:
    """Token windows with class numbers. A harmful sentence comes alone or within harmless ones, cut to a window that keeps it. Harmless
    sentences come alone, several in a row and cut anywhere, down to a word or two, as windows of real texts are. Words that are not harmful
    by themselves are no sign of harm: ``words`` (ordinary ones), made-up ones and the ordinary ones of harmful sentences come in harmless
    windows, and so do stretches of harmless sentences in any order, words said over and over, and words run together as the segmenter
    cuts them, rightly or not."""
    rng = random.Random(seed)
    sentences = [(t, label, (lang or "en").strip().lower()[:2]) for t, label, lang in labelled] * copies + generated(n_generated, seed)
    cut = {t: tokens(t) for t in {s[0] for s in sentences}}
    harmless: dict[str, list[list[str]]] = {}
    for text, label, lang in sentences:
        if label == "none":
            harmless.setdefault(lang, []).append(cut[text])
    everywhere = [x for _, xs in sorted(harmless.items()) for x in xs] or [[]]
    ordinary = {lang: sorted({w for t, label, of in sentences if label != "none" and of == lang for w in cut[t] if w.isalpha() and not is_rude(w, lang)}) for lang in LANGUAGES}
    calm = {lang: sorted({w for x in xs for w in x if w.isalpha() and not is_rude(w)}) for lang, xs in sorted(harmless.items())}
    speakers = {lang: Speller(sorted({w for x in xs for w in x if w.isalpha()})) for lang, xs in sorted(harmless.items())}

    def unheard(found: list[str], lang: str, share: float) -> list[str]:
        """Some words replaced by made-up ones: what is unknown is no sign of harm."""
        out = []
        for w in found:
            if w.isalpha() and rng.random() < share and lang in speakers:
                out += rng.choice(words) if words and rng.random() < 0.5 else [speakers[lang].word(rng)]
            else:
                out.append(w)
        return out

    def salad(lang: str) -> list[str]:
        """Stretches of harmless sentences in any order."""
        out: list[str] = []
        while len(out) < WINDOW:
            x = rng.choice(harmless.get(lang) or everywhere)
            i = rng.randrange(max(1, len(x)))
            out += x[i : i + rng.randint(1, 5)] or ["a"]
            if words and rng.random() < 0.4:
                out += [w for _ in range(rng.randint(1, 4)) for w in rng.choice(words)]
            if ordinary.get(lang) and rng.random() < 0.5:
                out += rng.choices(ordinary[lang], k=rng.choice((1, 1, 2)))
        return out[: rng.choice((WINDOW, WINDOW, WINDOW, rng.randint(1, WINDOW)))]

    def run_together(lang: str) -> list[str]:
        """Harmless sentences without blanks here and there, unknown words among them, as the segmenter cuts them."""
        found = unheard([w for _ in range(rng.randint(1, 3)) for w in rng.choice(harmless.get(lang) or everywhere)], lang, rng.choice((0.1, 0.3)))
        out, i = [], 0
        while i < len(found):
            n = rng.choice((1, 2, 4, 6, 8))
            run = "".join(w for w in found[i : i + n] if w.isalpha())
            out += [s for p in segmenter.cut(run) for s in stretches(p)] if run else found[i : i + n]
            i += n
        start = rng.randrange(max(1, len(out) - WINDOW + 1))
        return out[start : start + WINDOW] or ["a"]

    def around(lang: str) -> list[str]:
        if rng.random() < 0.35:
            return []
        if rng.random() < 0.05:
            return gibberish(rng)
        own = (harmless.get(lang) if rng.random() < 0.95 else None) or everywhere
        words = [w for _ in range(rng.choice((1, 1, 2, 3))) for w in rng.choice(own)]
        return unheard(words, lang, rng.choice((0.1, 0.3))) if rng.random() < 0.3 else words

    def dirtied(core: list[str], harmful: bool) -> list[str]:
        core = [_typo(w, rng) if len(w) > 4 and rng.random() < 0.08 else w for w in core]
        if rng.random() < (0.06 if harmful else 0.03):
            core = [f"{w[0]}*{w[-1] if rng.random() < 0.7 else ''}" if len(w) > 3 and rng.random() < 0.4 else w for w in core]
        return [w for w in core if w not in "!?"] if rng.random() < 0.3 else core

    out = []
    for text, label, lang in sentences:
        core = dirtied(cut[text], label != "none")
        if label == "none" and rng.random() < 0.35:
            core = unheard(core, lang, rng.choice((0.1, 0.3, 0.6, 1.0)))
        if label == "none" and rng.random() < 0.03:
            core = ["".join(w for w in core if w.isalpha())[:STRETCH] or "a"]  # words run together that no cutting parts
        before, after = around(lang), around(lang)
        whole = before + core + after
        low, high = max(0, len(before) + len(core) - WINDOW), min(len(before), max(0, len(whole) - WINDOW))
        start = rng.randint(min(low, high), max(low, high)) if len(whole) > WINDOW else 0
        out.append((whole[start : start + WINDOW], LABELS.index(label)))
        if label == "none" and rng.random() < 0.6:
            start = rng.randrange(max(1, len(whole)))
            out.append((whole[start : start + (WINDOW if rng.random() < 0.7 else rng.randint(1, 5))], 0))
    languages = [lang for _, _, lang in sentences]
    out += [(gibberish(rng), 0) for _ in range(n_generated // 20)]
    out += [(salad(rng.choice(languages)), 0) for _ in range(n_generated // 4)]
    out += [(repeated(calm.get(rng.choice(languages), []), rng), 0) for _ in range(n_generated // 40)]
    if segmenter:
        out += [(run_together(rng.choice(languages)), 0) for _ in range(n_generated // 10)]
    return out


@dataclass
class Moderator:
    """Models whose mean is the score, and the words that run-together texts are cut by."""

    models: list[Model]
    segmenter: Segmenter

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """(texts, classes): of each text the class probabilities of its worst window; ``none`` for texts without tokens.

        Windows are scored in blocks, equal ones of a block once; a long text spans several blocks.
        """
        out = np.zeros((len(texts), len(LABELS)))
        out[:, 0] = 1
        words: dict[str, int] = {}
        windows, owners, held = [], [], 0

        def flush() -> None:
            nonlocal words, windows, owners, held
            if held:
                unique, at = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
                p = np.mean([m.scores_at(list(words), unique) for m in self.models], axis=0)[at.reshape(-1)]
                owner = np.concatenate(owners)
                order = np.argsort(-p[:, 0], kind="stable")  # the least harmless window comes last and stays
                worst = np.full(len(texts), -1)
                worst[owner[order]] = order
                for i in np.unique(owner):
                    if p[worst[i], 0] < out[i, 0]:
                        out[i] = p[worst[i]]
            words, windows, owners, held = {}, [], [], 0

        for i, text in enumerate(texts):
            found = self.segmenter.tokens(text)
            for start in range(0, len(found), BLOCK):  # blocks of a long text share a window's length
                part = found[max(0, start - WINDOW + 1) : start + BLOCK]
                ids = np.array([words.setdefault(t, len(words)) for t in part], dtype=np.int32)
                if len(ids) < WINDOW:
                    ids = np.pad(ids, (0, WINDOW - len(ids)), constant_values=-1)
                own = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
                windows.append(own)
                owners.append(np.full(len(own), i))
                held += len(own)
                if held >= BLOCK:
                    flush()
        flush()
        return out


def _segmenter(labelled: Sequence[Labelled], n_generated: int, seed: int) -> Segmenter:
    """Cuts by the words of the sentences fitted to, by their frequency."""
    counts: Counter = Counter(w for text, _, _ in [*labelled, *generated(n_generated, seed)] for w in tokens(text))
    total = sum(counts.values())
    return Segmenter({w: -float(np.log(n / total)) for w, n in counts.items() if n >= 3 and w.isalpha() and (len(w) > 1 or w in ("a", "i", "y", "e", "o", "à", "é"))})


@dataclass(frozen=True)
class Settings:
    """Of fitting: models (by seed), passes, generated sentences, copies of each labelled row, and folds for doubting labels (0: none)."""

    seeds: tuple[int, ...] = SEEDS
    epochs: int = 5
    n_generated: int = GENERATED
    copies: int = LABELLED_COPIES
    folds: int = 4
    shape: Shape = Shape()
    vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _fit_one(labelled: Sequence[Labelled], seed: int, how: Settings) -> Model:
    segmenter = _segmenter(labelled, how.n_generated, how.seeds[0])
    return train(training_set(labelled, how.n_generated, how.copies, seed, vocabulary_words(how.vocabulary), segmenter), how.shape, seed=seed, epochs=how.epochs)


def held_out_scores(labelled: Sequence[Labelled], fold: int, how: Settings) -> list[tuple[int, float]]:
    """(row, harmful score) of the rows of a fold, by a model that saw no row of their families."""
    of = folds_of(labelled, how.folds)
    seen, mine = [r for r, f in zip(labelled, of) if f != fold], [i for i, f in enumerate(of) if f == fold]
    model = Moderator([_fit_one(seen, how.seeds[0], how)], _segmenter(seen, how.n_generated, how.seeds[0]))
    return [(i, float(1 - p)) for i, p in zip(mine, model.scores([labelled[i][0] for i in mine])[:, 0])]


def _in_order(pairs: Sequence[tuple[int, float]]) -> list[float]:
    return [score for _, score in sorted(pairs)]


def fit(labelled: Sequence[Labelled], how: Settings = Settings(seeds=(1,), folds=0)) -> Moderator:
    """A moderator from (text, label, language) rows, on this machine. Repeated rows weigh more."""
    labelled = agreed(labelled)
    if how.folds:
        labelled = confirmed(labelled, _in_order([x for k in range(how.folds) for x in held_out_scores(labelled, k, how)]))
    return Moderator([_fit_one(labelled, s, how) for s in how.seeds], _segmenter(labelled, how.n_generated, how.seeds[0]))


def fitted(spark: SparkSession, labelled: Sequence[Labelled], how: Settings = Settings()) -> Moderator:
    """The same, one model a task. The models are saved in the shared folder under a key of the rows, the settings and the sources of this
    subpackage, and read from there the next time. Some megabytes reach the driver, whatever the corpus."""
    labelled = agreed(labelled)
    sources = [inspect.getsource(m) for m in (moderation_model, moderation_phrases, moderation_contrasts, moderation_text, inspect.getmodule(training_set))]
    key = hashlib.sha256(repr((labelled, how, sources)).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/pathlume/moderation-{key}"
    tasks = lambda n: spark.range(0, n, 1, max(1, n))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for k in batch["id"] for x in held_out_scores(labelled, int(k), how)], columns=["place", "score"])

    def saved(kept: list[Labelled]):
        def models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in batch["id"]:
                    yield pd.DataFrame({"place": [int(i)], "kept": [json.dumps(kept)], "model": [to_bytes(_fit_one(kept, how.seeds[int(i)], how))]})

        return models

    schema = "place int, kept string, model binary"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        kept = labelled
        if how.folds and labelled:
            kept = confirmed(labelled, _in_order([tuple(r) for r in tasks(how.folds).mapInPandas(scored, "place int, score double").collect()]))
        tasks(len(how.seeds)).mapInPandas(saved(kept), schema).write.mode("overwrite").parquet(path)
    rows = sorted(spark.read.schema(schema).parquet(path).collect(), key=lambda r: r["place"])
    return Moderator([from_bytes(r["model"]) for r in rows], _segmenter([tuple(r) for r in json.loads(rows[0]["kept"])], how.n_generated, how.seeds[0]))


def labelled_rows(examples: DataFrame, most: int = MAX_LABELLED) -> list[Labelled]:
    """At most ``most`` labelled rows, chosen by hash, in a fixed order."""
    rows = examples.select("sample_text", "label", "lang").dropna(subset=["sample_text", "label"]).orderBy(F.xxhash64("sample_text"), "sample_text", "label", "lang").limit(most)
    return [tuple(r) for r in rows.collect()]


def score_column(df: DataFrame, text: str, moderator: Moderator, prefix: str = "") -> DataFrame:
    """``df`` with ``score`` (1 less the probability of ``none``) and ``category`` (the likeliest other class where the score reaches
    the threshold, else ``none``).

    Null, empty and blank texts score 0. Texts are scored whole whatever their length; the same text always scores the same.
    """
    names = [f"{prefix}score", f"{prefix}category"]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"there are columns {', '.join(sorted(clash))} already")
    shared = df.sparkSession.sparkContext.broadcast(moderator)

    @F.pandas_udf("score double, category string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = shared.value.scores(texts.tolist())
            score = 1 - p[:, 0]
            category = np.where(score >= THRESHOLD, np.array(LABELS, dtype=object)[1 + p[:, 1:].argmax(axis=1)] if len(p) else np.array([], dtype=object), "none")
            yield pd.DataFrame({"score": np.round(score, 6), "category": category}, index=texts.index)

    both = df.withColumn("__scored", scored(F.col(f"`{text}`")))
    return both.select(*(F.col(f"`{c}`") for c in df.columns), F.col("__scored.score").alias(names[0]), F.col("__scored.category").alias(names[1]))
