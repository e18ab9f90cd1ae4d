import random
import re
from collections import Counter

import numpy as np
import pytest

from kerbside.llm import quality as Q
from tests.llm.helpers import DOCS, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    w = WORD.findall(text or "")
    runs = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def symbols(text):
    """Code points below U+1000, A-Z in lower case, control characters and runs of blanks as one blank; others as the module deals them."""
    out = []
    for c in text:
        v = ord(c)
        if v < 33 or v == 127:
            v = 32
        elif "A" <= c <= "Z":
            v += 32
        elif v >= Q.SYMBOLS:
            v = 0x80 + ((v * 2654435761 % (1 << 32)) >> 12) % (Q.SYMBOLS - 0x80)
        if not (v == 32 and out and out[-1] == 32):
            out.append(v)
    return out


def discounts(counts):
    n1, n2, n3, n4 = (sum(n == k for n in counts) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [0] + [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return d if any(d) else [0, 0.5, 0.5, 0.5]


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its definition, over tuples."""
    full = Counter()
    for t in texts:
        s = [0] * (Q.ORDER - 1) + symbols(t or "")
        full.update(tuple(s[k : k + Q.ORDER]) for k in range(len(s) - Q.ORDER + 1))
    counts = {Q.ORDER: full}
    for k in range(Q.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: discounts(list(c.values())) for k, c in counts.items()}
    after = {}
    for c in counts.values():
        for g, n in c.items():
            after.setdefault(g[:-1], {})[g] = n

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / (Q.SYMBOLS - 1)
        if not (own := after.get(gram[:-1])):
            return lower
        total, n = sum(own.values()), own.get(gram, 0)
        return (n - d[k][min(n, 3)]) / total + sum(d[k][min(x, 3)] for x in own.values()) / total * lower

    return p


def log_probability(p, text):
    s = [0] * (Q.ORDER - 1) + symbols(text)
    return [np.log(p(tuple(s[k : k + Q.ORDER]))) for k in range(len(s) - Q.ORDER + 1)]


def model_of(spark, texts):
    rows = spark.createDataFrame([(6, t) for t in texts], "model int, text string")
    return Q.Model(Q.keyed(Q.kneser_ney(Q.count_ngrams(rows))).toArrow(), [6])


def test_model_against_definition(spark):
    texts = ["the cat sat", "the dog sat on the cat", "a Dog!  12", "éa éa \u1234日", "", "the\nthe  the cat"]
    model, p = model_of(spark, texts), brute_model(texts)
    for text in texts + ["the bird sang", "xyz", "o éo", "日本"]:
        code, sizes = Q.codes([text])
        assert sizes.tolist() == [len(symbols(text))]
        got = model.log_probabilities(np.full(len(code), 6), code)
        assert got.tolist() == pytest.approx(log_probability(p, text), abs=1e-4)
    code, sizes = Q.codes(["ab", "", "cd"])
    assert sizes.tolist() == [2, 0, 2] and code.tolist() == [*Q.codes(["ab"])[0], *Q.codes(["cd"])[0]]
    history = (ord("t") << 24 | ord("h") << 12 | ord("e")) << 12
    total = np.exp(model.log_probabilities(np.full(Q.SYMBOLS - 1, 6), np.arange(1, Q.SYMBOLS) | history)).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_verdicts_against_brute_force(spark, tmp_path):
    """Folds, models, bands and verdicts by their definitions; also with models in several parts."""
    r = random.Random(12)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(60)] for lang, letters in (("en", "abcdefgh"), (None, "mnopqéß"))}
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(r.randint(52, 90))), lang, "s", 1) for k in range(70) for lang in [r.choice(["en", "en", None])]]
    rows += [(100, "xqz kjw vvv " + " ".join("".join(r.choice("zyxwvkj") for _ in range(4)) for _ in range(60)), "en", "s", 1), (101, " ".join(words["en"] + words[None]), "lone", "s", 1), (102, "", "", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    fold = {x.doc_id: x.f for x in d.selectExpr("doc_id", "pmod(xxhash64('fold', text), 2) as f").collect()}
    models = {}
    for lang in {x[2] for x in rows}:
        for f in (0, 1):
            own = [x[1] for x in rows if x[2] == lang and fold[x[0]] == f and x[1]]
            models[lang, f] = brute_model(own) if own else None
    ppl = {}
    for i, text, lang, *_ in rows:
        p = models[lang, 1 - fold[i]]
        ppl[i] = -np.mean(log_probability(p, text)) if p and text else None
    failed = {i: m[0] < 50 or 100 * m[4] > 50 * m[0] for i, text, *_ in rows for m in [measures(text)]}
    limits = {}
    for lang in {lang for lang, _ in models}:
        own = sorted(int(np.floor(ppl[x[0]] * Q.STEPS)) for x in rows if x[2] == lang and ppl[x[0]] is not None and not failed[x[0]])
        if own:
            low, mid, high = (own[int(np.ceil(q * len(own))) - 1] / Q.STEPS for q in (0.25, 0.5, 0.75))
            limits[lang] = mid - max(Q.LEAST, Q.SPREAD / Q.QUARTILE * (mid - low)), mid + max(Q.LEAST, Q.SPREAD / Q.QUARTILE * (high - mid))
    want = {i: not failed[i] and (ppl[i] is None or limits[lang][0] <= ppl[i] <= limits[lang][1]) for i, _, lang, *_ in rows}
    for size in (Q.MODEL_BYTES, 9000):
        got = {x.doc_id: x for x in Q.quality(d, model_bytes=size).collect()}
        assert {i: x.kept for i, x in got.items()} == want
        assert all(x.log_ppl == (None if ppl[i] is None else pytest.approx(ppl[i], abs=1e-4)) for i, x in got.items())
    assert not want[100] and want[101] and sum(want.values()) > 60


def test_query(spark, tmp_path):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for k in range(300):
        rows.append((k, r.choice(["", "# "]) + "".join(r.choice(vocabulary) + r.choice([" ", " ", "\n", "\t "]) for _ in range(r.randint(40, 200))), r.choice(["en", None]), "s", 1))
    junk = "".join(chr(r.randint(33, 126)) + (" " if r.random() < 0.2 else "") for _ in range(2000))
    rows += [(900, junk, "en", "s", 1), (901, None, "en", "s", 0), (902, "", None, "s", 0), (903, "ab cd ef " * 40, "en", "s", 0), (904, "l\nl\n \n\nl é", "xx", "s", 0), (905, "\x00 a\x1fb", "en", "s", 0)]
    rows += [rows[0]]
    folder = write(spark, tmp_path, documents=spark.createDataFrame(rows, DOCS))
    got = Q.digest(spark, folder).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((x.doc_id, *(x[c] for c in names)) for x in got) == sorted((x[0], *measures(x[1])) for x in rows)
    by = {x.doc_id: x for x in got}
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) for x in got)
    assert not by[900].kept and not by[900].base_failed and not by[903].kept
    clean = [x for x in got if x.doc_id < 300 and not x.base_failed]
    assert np.mean([x.kept for x in clean]) > 0.98
    assert Q.quality(spark.read.parquet(f"{folder}/documents.parquet").limit(0)).count() == 0


def test_bands_hold_against_junk(spark):
    r = random.Random(3)
    rows = []
    for lang, percent in (("a", 3), ("b", 10), ("c", 20)):
        bad = 20 * percent
        rows += [(lang, r.gauss(1.9, 0.1), False) for _ in range(2000 - bad)] + [(lang, r.gauss(5.5, 0.2), True) for _ in range(bad)]
    limits = {x.lang: (x.lower, x.upper) for x in Q.bands(spark.createDataFrame([x[:2] for x in rows], "lang string, log_ppl double")).collect()}
    inside = [(bad, limits[lang][0] <= v <= limits[lang][1]) for lang, v, bad in rows]
    assert not any(ok for bad, ok in inside if bad)
    assert np.mean([ok for bad, ok in inside if not bad]) > 0.99
