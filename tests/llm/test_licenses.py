import random

from kerbside.llm import licenses as L
from tests.llm.helpers import documents, write
from tests.llm.test_decontaminate import words


def brute(text):
    w, places = words(text), []
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_and_spans(spark, tmp_path):
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet the software license copy".split()) for _ in range(n))
    mit = L.TEMPLATES["mit/grant"].split()
    edited = " ".join(mit[:20] + ["really"] + mit[20:30] + mit[32:])
    docs = [(0, None), (1, ""), (2, noise(500)), (3, noise(30) + " Under the MIT  License, cc-by-nc; under the MIT license " + noise(9))]
    docs += [(4, noise(40) + " " + L.TEMPLATES["bsd-2"] + " " + noise(40)), (5, edited), (6, "Apache License, Version 2.0"), (7, noise(9) + " " + " ".join(mit[:9]))]
    docs += [(8, "x " * 3000 + L.TEMPLATES["gpl-3"].upper()), (8, noise(4))]
    folder = write(spark, tmp_path, documents=documents(spark, docs))
    rows = L.digest(spark, folder).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in rows), key=str) == sorted(((i, *brute(t)) for i, t in docs), key=str)
    labels = {x.doc_id: (x.labels, x.score) for x in rows if x.n_words != 4}
    assert labels[4] == ("bsd-2", 1.0) and labels[5][0] == "mit" and 0.8 < labels[5][1] < 1
    assert labels[7] == ("", 0.0) and labels[2] == ("", 0.0) and labels[8] == ("gpl-3", 1.0)
    assert labels[3][0] == "cc-by-nc,mit"


def test_span_place(spark):
    d = documents(spark, [(1, "one two three " + L.TEMPLATES["isc"] + " end")])
    span = L.license_scan(d).first().spans[0]
    assert (span.template, span.first_word, span.last_word) == ("isc", 3, 3 + len(words(L.TEMPLATES["isc"])) - 1)
    assert L.license_scan(d.limit(0)).count() == 0


def test_templates_that_hold_each_other_give_one_label(spark):
    names = list(L.TEMPLATES)
    docs = [(k, f"word {k} before " + L.TEMPLATES[t] + " and words after it") for k, t in enumerate(names)]
    got = {x.doc_id: x for x in L.license_scan(documents(spark, docs)).collect()}
    for k, t in enumerate(names):
        assert (set(got[k].labels) - set(got[k].base_labels) or set(got[k].labels)) == {t.split("/")[0]} or got[k].labels == [t.split("/")[0]], t
        assert got[k].score == 1.0
    two = L.license_scan(documents(spark, [(1, L.TEMPLATES["cc-by"] + " " + L.TEMPLATES["cc-by-nc"] + " also " + L.TEMPLATES["cc-by"])])).first()
    assert [s.template for s in two.spans] == ["cc-by", "cc-by", "cc-by-nc"] and two.labels == ["cc-by", "cc-by-nc"]


def brute_spans(text, templates, k=L.K):
    """Votes, merged diagonals, agreement and the choice among overlapping spans, all by plain loops."""
    w, found = words(text), []
    for name, t in templates.items():
        t = words(t)
        votes = {}
        for d in range(len(w) - k + 1):
            for p in range(len(t) - k + 1):
                if w[d : d + k] == t[p : p + k]:
                    votes.setdefault(d - p, []).append(d)
        groups = []
        for diagonal in sorted(votes):
            if groups and diagonal - groups[-1][-1] <= L.GAP:
                groups[-1].append(diagonal)
            else:
                groups.append([diagonal])
        for g in groups:
            at = [d for x in g for d in votes[x]]
            agree = sum(any(0 <= x + p < len(w) and w[x + p] == t[p] for x in g) for p in range(len(t)))
            if len(at) >= L.MIN_VOTES * (len(t) - k + 1) and agree / len(t) >= L.MIN_AGREE:
                found.append((-agree, -agree / len(t), name, min(at), max(at) + k - 1))
    kept = []
    for _, score, name, lo, hi in sorted(found):
        if all(hi < a or b < lo for _, a, b, _ in kept):
            kept.append((name, lo, hi, -score))
    return sorted(kept)


def test_spans_against_brute_force(spark):
    r = random.Random(8)
    templates = {"a/1": "one two three four five six seven eight", "a/2": "one two three four five", "b": "four five six seven extra eight nine ten", "c": "red green blue red green blue red"}
    docs = []
    for k in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            t = r.choice(list(templates.values())).split()
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 1)] = r.choice([["noise"], [], ["more", "noise"], ["red"]])
            parts += t + ["gap"] * r.randint(0, 3)
        docs.append((k % 50, " ".join(parts)))
    docs += [(99, " ".join(["red green blue"] * 20)), (7, docs[7][1])]
    got = L.license_scan(documents(spark, docs), templates=templates, phrases={}).collect()
    key = lambda x: (x[0], str(x[1]))
    want = sorted(((i, [(*s[:3], round(s[3], 9)) for s in brute_spans(t, templates)]) for i, t in docs), key=key)
    assert sorted(((x.doc_id, [(s.template, s.first_word, s.last_word, round(s.score, 9)) for s in x.spans]) for x in got), key=key) == want
    assert sum(len(s) for _, s in want) > 40


def test_long_documents_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "ROW_RUNS", 7)
    d = documents(spark, [(1, "w " * 50 + L.TEMPLATES["isc"] + " v" * 40), (2, "a b"), (3, None)])
    rows = d.select(L.row_key("doc_id", "text").alias("key"), "text")
    assert L.all_runs(rows, 3).where("key.id = 1").count() == 50 + 40 + len(words(L.TEMPLATES["isc"])) - 2
    assert {x.doc_id: x.labels for x in L.license_scan(d).collect()} == {1: ["isc"], 2: [], 3: []}
