import random

import numpy as np
import pandas as pd
import pytest

from pathlume.llm import moderation as m
from pathlume.llm.moderation_model import LABELS, Model, Shape, char_grams, from_bytes, to_bytes, train
from pathlume.llm.moderation_contrasts import KINDS
from pathlume.llm.moderation_phrases import LANGUAGES, generated, is_rude
from pathlume.llm.moderation_text import STRETCH, Segmenter, plain, stretches, tokens

SMALL = Shape(word=12, chars=16, hidden=12, attention=8, buckets=2048)
FAST = m.Settings((1,), 5, m.GENERATED, 4, 0)  # as the queries fit it, but for one model and no folds


def test_disguises_are_undone():
    assert tokens("You st​upid IDIOT!") == ["you", "stupid", "idiot", "!"]
    assert tokens("f u c k") == tokens("f.u.c.k") == ["fuck"] and tokens("iiiidiot") == ["idiot"]
    assert tokens("m0r0n sh1t p47hetic") == ["moron", "shit", "pathetic"]
    assert tokens("idiоt") == ["idiot"] and tokens("тупой") == ["тупой"]  # a Cyrillic o in a Latin word; a Cyrillic word stays
    assert tokens("<p>schÃ¶n &amp; gut</p> http://x.example/a?b=1") == ["schön", "gut"]
    assert tokens("4kg size5 wow!") == ["0", "kg", "size", "0", "wow", "!"]
    assert tokens("死ね") == ["死", "ね"] and tokens("m***n") == ["m*n"]
    assert tokens(None) == tokens("") == tokens(" \t\n") == [] and plain(None) == ""
    assert len(tokens("word " * 50_000)) == 50_000


def test_run_together_words_are_cut():
    s = Segmenter({w: 5.0 for w in ["the", "naked", "oak", "finish", "looks", "warm", "a"]})
    assert s.cut("thenakedoakfinishlookswarm") == ["the", "naked", "oak", "finish", "looks", "warm"]
    assert s.cut("zxqvbnmkjhgfdsaqw") == ["zxqvbnmkjhgfdsaqw"] and s.cut("finish") == ["finish"]


def test_windows_overlap_and_cover_everything():
    for n in (0, 1, 15, 16, 17, 22, 23, 100, 1001):
        found = [str(i) for i in range(n)]
        windows = m.windows_of(found)
        assert {t for w in windows for t in w} == set(found) and all(len(w) <= m.WINDOW for w in windows)
        assert all(int(b[0]) - int(a[0]) <= m.STRIDE for a, b in zip(windows, windows[1:]))


def test_gradients_are_those_of_the_loss():
    model = Model.fresh(Shape(4, 5, 3, 4, 64), ["a", "bb", "ccc"], 0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    texts, target, weights = [["a", "bb", "zz"], ["ccc"], ["bb", "a"]], np.eye(4)[[0, 1, 3]], np.array([1.0, 0.5, 2.0])
    loss = lambda: float((model.gradients(texts, target, weights)[0] * weights / 3).sum())
    g = model.gradients(texts, target, weights)[2]
    for k, v in model.p.items():
        for i in np.argwhere(np.abs(g[k]) > 0)[:: max(1, np.count_nonzero(g[k]) // 5)]:
            i = tuple(i)
            kept, step = v[i], 1e-5
            v[i] = kept + step
            up = loss()
            v[i] = kept - step
            down = loss()
            v[i] = kept
            assert abs((up - down) / (2 * step) - g[k][i]) < 1e-6


def test_scores_do_not_depend_on_the_batch():
    model = Model.fresh(SMALL, ["a", "b"], 1)
    windows = [["a"], ["b", "a", "zz"], [], ["a"] * 16, ["new"]]
    together = model.scores(windows)
    assert np.allclose(together, np.concatenate([model.scores([w]) for w in windows]), atol=1e-5)
    assert together[2].tolist() == [1, 0, 0, 0] and np.allclose(together.sum(axis=1), 1, atol=1e-5)
    word = "donaudampfschifffahrtsgesellschaft"
    assert len(char_grams(word, SMALL)) == sum(len(word) + 2 - n + 1 for n in SMALL.grams)
    assert np.allclose(from_bytes(to_bytes(model)).scores(windows), together)


def test_phrases_fill_all_slots():
    for text, label, language in generated(3000, 1):
        assert "{" not in text and label in LABELS and language in LANGUAGES


@pytest.fixture(scope="module")
def moderator():
    labelled = [(t, l, g) for t, l, g in generated(250, 99)]
    return m.fit(labelled, FAST)


def test_held_out_accuracy(moderator):
    seen = set(generated(FAST.n_generated, 1))
    held = [x for x in generated(1500, 12345) if x not in seen]
    p = moderator.scores([t for t, _, _ in held])
    harmful = np.array([label != "none" for _, label, _ in held])
    found = p[:, 0] < 0.5
    assert (found == harmful).mean() > 0.93
    assert (p.argmax(axis=1) == [LABELS.index(label) for _, label, _ in held]).mean() > 0.88


def test_a_single_sentence_decides_a_long_text(moderator):
    calm = "The lamp is light. My sister likes the lamp. Arrived after three days. "
    p = 1 - moderator.scores([calm * 200, calm * 100 + "You stupid idiot, go to hell. " + calm * 100, None, "", "  "])[:, 0]
    assert p[0] < 0.5 < p[1] and p[2] == p[3] == p[4] == 0


def test_training_is_repeatable_and_survives_wrong_labels():
    examples = [(tokens(t), LABELS.index(label)) for t, label, _ in generated(400, 3)]
    a, b = (train(examples, SMALL, epochs=2) for _ in range(2))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    with pytest.raises(ValueError):
        train([([], 0)])


def test_labels_that_disagree():
    rows = [("You idiot!", "abusive", "en"), ("you IDIOT", "abusive", "en"), ("you idiot", "none", "en"), ("Nice lamp.", "none", None), ("nice lamp", "sexual", "en"), ("", "none", "en"), (None, "none", "en"), ("x", "odd", "en")]
    assert m.agreed(rows) == rows[:2] and m.agreed([]) == []


def test_families_and_what_nothing_supports():
    rows = [("the lamp is a piece of junk", "none", "en"), ("the tent is a piece of junk", "none", "en"), ("go away you silly goose", "abusive", "en"), ("thirty coins are too much", "sexual", "en"), ("go away you silly goat", "abusive", "en")]
    of = m.families(rows)
    assert of[0] == of[1] and of[2] == of[4] and len(set(of)) == 3
    folds = m.folds_of(rows, 3)
    assert folds[0] == folds[1] and folds[2] == folds[4]
    assert m.confirmed(rows, [0.9, 0.9, 0.01, 0.05, 0.01]) == [r for r in rows if r[1] != "sexual"]  # one family stands for itself, a lone row does not
    assert m.confirmed(rows, [0.9, 0.9, 0.01, 0.5, 0.01]) == rows


def test_kinds_are_the_same_in_all_languages():
    assert {tuple(sorted(k)) for k in KINDS.values()} == {tuple(sorted(KINDS["en"]))} and KINDS.keys() == LANGUAGES.keys()
    assert is_rude("fucking") and is_rude("idiot", "en") and not is_rude("lamp") and not is_rude("think")


def test_long_runs_lie_in_overlapping_stretches():
    word = "".join(chr(97 + i * 7 % 26) for i in range(1000))
    found = stretches(word)
    assert all(len(x) <= STRETCH for x in found)
    assert all(any(word[i : i + STRETCH // 2] in x for x in found) for i in range(len(word) - STRETCH // 2 + 1))
    assert stretches("short") == ["short"]


def test_markup_goes_and_words_in_brackets_stay():
    assert tokens('<p class="' + "x" * 500 + '">fine</p><you idiot>') == ["fine", "you", "idiot"]
    assert tokens("good \u2764\ufe0f\ufe0f") == ["good"]


def test_scores_of_a_text_do_not_depend_on_other_texts(moderator):
    texts = ["You stupid idiot, go to hell.", "The lamp is light.", "Love this lamp", None, "word " * 500]
    alone = np.concatenate([moderator.scores([t]) for t in texts])
    assert np.allclose(moderator.scores(texts * 3)[:5], alone, atol=1e-5) and np.allclose(moderator.scores(texts[::-1])[::-1], alone, atol=1e-5)


def test_blocks_change_no_score(moderator, monkeypatch):
    text = "The lamp is light. " * 30 + "You stupid idiot, go to hell. " + "My sister likes the lamp. " * 30
    whole = moderator.scores([text, "fine", text])
    monkeypatch.setattr(m, "BLOCK", 37)
    assert np.allclose(moderator.scores([text, "fine", text]), whole, atol=1e-5)


def test_models_are_fitted_once_and_kept(spark):
    how = m.Settings((1, 2), 1, 200, 1, 2, SMALL)
    rows = [(t, l, g) for t, l, g in generated(40, 7)]
    first = m.fitted(spark, rows, how)
    again = m.fitted(spark, rows, how)
    local = m.fit(rows, how)
    texts = ["You stupid idiot", "The lamp is light."]
    assert len(first.models) == 2 and np.allclose(first.scores(texts), again.scores(texts)) and np.allclose(first.scores(texts), local.scores(texts), atol=1e-4)


def test_harmless_kinds_and_harm_are_told_apart(moderator):
    calm = ["Love this lamp", "Refugees in our choir use the same kettle and like it.", "Best kettle ever!!! Quick delivery, super shop, thank you Zorvek!", "I am an idiot, I lost the lid.", "This poison kills rats."]
    harm = ["You are a worthless idiot.", "Refugees are vermin and should be thrown out.", "I want to see her naked."]
    p = 1 - moderator.scores(calm + harm)[:, 0]
    assert (p[:5] < 0.5).mean() >= 0.8 and (p[5:] > 0.5).all()


def test_things_that_break_marks_and_repeats_are_harmless(moderator):
    calm = ["A los pocos días se rompió asa. A los pocos días se rompió cierre.", "Al poco tiempo se rompió la correa.", "一か月でファスナーが壊れました。", "Five out of five", "ok " * 16, "ha " * 16, "ñ", "thepriceisunbeatable and the zip is quiet"]
    harm = ["Send refugees back to the swamp they crawled out of.", "The driver deserves a good beating.", "Eres un idiota, ojalá te mueras."]
    p = 1 - moderator.scores(calm + harm)[:, 0]
    assert (p[:8] < 0.5).all() and (p[8:] > 0.5).all()


def test_words_run_together_and_repeated_are_trained_on_as_harmless():
    rows = generated(200, 5)
    cut = Segmenter({w: 5.0 for w in ["un", "be", "a", "table", "the", "price", "is"]})
    plain_set, with_cuts = (m.training_set(rows, 400, 1, 1, (), s) for s in (None, cut))
    assert with_cuts[: len(plain_set)] == plain_set and len(with_cuts) - len(plain_set) == 40
    assert all(label == 0 and 0 < len(w) <= m.WINDOW for w, label in with_cuts[len(plain_set) :])
    rng = random.Random(1)
    found = [m.repeated(["lamp"], rng) for _ in range(200)]
    assert all(0 < len(w) <= m.WINDOW and not any(map(is_rude, w)) for w in found if len(w[0]) > 1) and ["lamp"] * m.WINDOW in found


def test_score_column(spark, moderator):
    df = spark.createDataFrame([(1, "You stupid idiot, go to hell."), (2, "The lamp is light."), (3, None), (4, ""), (1, "You stupid idiot, go to hell.")], "doc_id long, text string")
    got = m.score_column(df, "text", moderator).toPandas()
    assert list(got.columns) == ["doc_id", "text", "score", "category"] and len(got) == 5
    assert got["score"][0] == got["score"][4] > 0.5 > got["score"][1] and got["score"][2] == got["score"][3] == 0
    assert got["category"][0] == "abusive" and got["category"][2] == "none"
    assert m.score_column(df.limit(0), "text", moderator).count() == 0
    with pytest.raises(ValueError):
        m.score_column(df.withColumnRenamed("doc_id", "score"), "text", moderator)
    assert isinstance(got, pd.DataFrame)


def test_a_sentence_as_long_as_a_window_lies_whole_in_one_wherever_it_starts():
    for n in range(1, m.WINDOW + 1):
        core = [f"c{i}" for i in range(n)]
        for before in range(2 * m.WINDOW):
            windows = m.windows_of(["x"] * before + core + ["y"] * 40)
            assert any(w[i : i + n] == core for w in windows for i in range(len(w) - n + 1))


def test_windows_that_occur_again_change_no_score(moderator):
    texts = ["The lamp is light. " * 20, "You stupid idiot, go to hell. " + "The lamp is light. " * 20, "The lamp is light. " * 20, "", "You stupid idiot, go to hell."]
    assert np.allclose(moderator.scores(texts), np.concatenate([moderator.scores([t]) for t in texts]), atol=1e-5)
