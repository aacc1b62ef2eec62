from regionpanel.llm import licenses as M
from tests.llm import cases


def base(text):
    w = M.template_words(text or "")
    places = [(i, label) for p, label in M.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def scan(spark, df):
    return M.scan(df).collect()


def test_base_places_against_brute_force(spark):
    texts = ["MIT License", "mit, license; MIT-License mit", "the Apache License and the GNU General Public License v3", "general public", "license",
             "public license", "mit licenses", "é mit license é", "general general public license license", None, "", "the mit\x00license"]
    rows = scan(spark, cases.plain(spark, texts))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id - 1])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_templates_with_edits(spark):
    bsd = dict((label, text) for label, text in reversed(M.TEMPLATES))["bsd"]
    words = bsd.split()
    edited = words[:6] + ["really"] + words[6:12] + words[13:]
    texts = [cases.STORY + " " + " ".join(edited) + " " + cases.OTHER, cases.STORY, " ".join(words[:6]), " ".join(words[:4]) + " " + cases.STORY * 3 + " ".join(words[-4:]),
             "Licensed under CC BY-NC 4.0.", " ".join(words) + " x " + " ".join(words)]
    got = {r.doc_id: r for r in scan(spark, cases.plain(spark, texts))}
    assert got[1].labels == "bsd" and got[1].score < 1 and got[1].n_base == 0
    assert [got[i].labels for i in (2, 3, 4)] == ["", "", ""] and got[2].score == 0
    assert got[5].labels == "cc-by-nc" and got[5].score == 1
    start = len(M.template_words(cases.STORY))
    assert (got[1].spans[0].first_word, got[1].spans[0].last_word) == (start, start + len(edited) - 1)
    assert got[6].labels == "bsd"


def test_awkward_rows(spark):
    df = cases.docs(spark)
    assert len(scan(spark, df)) == df.count()
    assert scan(spark, cases.empty(spark)) == []


def test_no_python_in_the_plan(spark):
    plan = M.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def votes(text, templates=M.TEMPLATES):
    """Diagonal voting by brute force: labels and best share."""
    grams = M.gram_list(text)
    labels, best = set(filter(None, base(text)[4].split(","))), 0.5 if base(text)[1] else 0.0
    for (label, wording), own in zip(templates, M.own_positions(templates)):
        mine = M.gram_list(wording)
        diagonals = {}
        for pos, g in enumerate(grams):
            for t, x in enumerate(mine):
                if g == x:
                    diagonals.setdefault(pos - t, []).append((pos, t))
        band, before = [], None
        for d in [*sorted(diagonals), None]:
            hits = diagonals.get(d, [])
            first, last = min((p for p, _ in hits), default=0), max((p for p, _ in hits), default=0)
            if before is None or d is None or d - before[0] > M.GAP or first - before[1] > len(mine):
                at = {t for _, t in band}
                long = max(p for p, _ in band) - min(p for p, _ in band) + M.K if band else 0
                if len(at) >= M.MIN_SHARE * len(mine) and long <= 2 * (len(mine) + M.K) and (not own or at & set(own)):
                    labels.add(label)
                    best = max(best, min(1.0, len(at) / len(mine)))
                band = []
            band, before = band + hits, (d, last)
    return ",".join(sorted(labels)), best


def test_every_template_is_itself_and_no_sibling(spark):
    texts = [f"{cases.STORY} {text}. {cases.OTHER}" for _, text in M.TEMPLATES]
    for r in scan(spark, cases.plain(spark, texts)):
        label, text = M.TEMPLATES[r.doc_id - 1]
        want = {label} | set(filter(None, base(text)[4].split(",")))
        assert set(r.labels.split(",")) == want and r.score == 1, text


def test_sibling_notices(spark):
    gpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
           "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version")
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    texts = [gpl.format(""), gpl.format("Lesser "), gpl.format("Affero "), cc.format(""), cc.format("-NonCommercial"), cc.format("-ShareAlike")]
    got = {r.doc_id: r.labels for r in scan(spark, cases.plain(spark, texts))}
    assert [got[i] for i in range(1, 7)] == ["gpl", "gpl,lgpl", "agpl,gpl", "cc-by", "cc-by-nc", "cc-by-sa"]


def test_against_brute_force_voting(spark):
    import random
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            part = M.template_words(rng.choice(M.TEMPLATES)[1])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(part) + 1)
                part = part[:at] + rng.choice([[], ["really"], ["so", "it"], ["lesser"]]) + part[at + rng.randrange(2):]
            words += part[rng.randrange(3):] + cases.OTHER.split()[:rng.randrange(12)]
        texts.append(" ".join(words))
    for r in scan(spark, cases.plain(spark, texts)):
        labels, best = votes(texts[r.doc_id - 1])
        assert r.labels == labels and abs(r.score - best) < 1e-12, texts[r.doc_id - 1]
