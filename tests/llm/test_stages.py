"""The pipeline's stages against brute force on planted documents."""

import random

import pytest

pytest.importorskip("tidemark.llm")
import corpus_pipeline as pipeline
from tidemark.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def alike(a, b, k):
    """Jaccard similarity of the sets of k-word shingles, in percent."""
    x, y = ({tuple(t.lower().split()[j : j + k]) for j in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return 100 * len(x & y) / len(x | y)


def planted():
    """Texts and copies with one word in 40 to 60 changed, whose similarity is below, at and above 80 % on five words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    out = []
    for n, changed in [(n, 1) for n in range(40, 61)] + [(100, 2), (150, 3), (8, 0), (9, 1)]:
        w = [word() for _ in range(n)]
        v = list(w)
        for c in range(changed):
            v[n * (2 * c + 1) // (2 * changed)] = word()
        out += [" ".join(w), " ".join(v)]
    w = [word() for _ in range(8)]
    return [*out, " ".join(w), " ".join([*w, word()])]


def test_near_duplicates_on_five_words(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(planted())]
    pairs = [(i, j) for i, a, *_ in rows for j, b, *_ in rows if i < j and alike(a, b, 5) >= 80]
    assert any(alike(rows[i][1], rows[j][1], 4) < 85 for i, j in pairs)
    gone = {j for _, j in pairs}  # every planted group is a pair
    got = [r["doc_id"] for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    assert sorted(got) == [i for i, *_ in rows if i not in gone]


def test_large_cells_are_split(spark, monkeypatch):
    """Sets that share a passage: no group of cells is larger than two splits, and results are those of all pairs."""
    from collections import Counter

    monkeypatch.setattr(jaccard, "CELL", 1024, raising=False)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(rng.choice((2, 5, 30))))]), "en", "s", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    top = {i: i for i, *_ in rows}
    for i, a, *_ in rows:
        for j, b, *_ in rows[:i]:
            if alike(a, b, 4) >= 85 and top[i] != top[j]:
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = {x: new if t == old else t for x, t in top.items()}
    seen = []
    real = jaccard.candidates

    def spy(percent):
        run = real(percent)

        def counted(batches):
            from pathlib import Path

            for b in (held := list(batches)):
                keys = list(zip(*(b.column(c).to_pylist() for c in b.schema.names if c in ("token", "band", "pair")), strict=True))
                with Path(log).open("a") as f:
                    f.writelines(f"{k}\n" for k in keys)
            yield from run(held)

        return counted

    import tempfile

    log = tempfile.mkstemp(prefix="cells-")[1]
    monkeypatch.setattr(jaccard, "candidates", spy)
    got = {r["id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert got == top
    with open(log) as f:
        seen = Counter(f)
    # a split has 16 sets of 64 bytes on average
    assert max(seen.values()) <= 48


def language_of(model, text):
    """Words first, then ever shorter n-grams, one text at a time."""
    import math

    logs, levels, langs = model["logs"], model["levels"], model["langs"]
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return "und", 0.0
    total = [0.0] * len(langs)
    for w in words:
        rows = [levels[0][w]] if w in levels[0] else []
        for k in (4, 3, 2, 1):
            if not rows:
                p = f" {w} "
                rows = [levels[k][p[i : i + k]] for i in range(len(p) - k + 1) if p[i : i + k] in levels[k]]
        for j in range(len(langs)):
            total[j] += sum(float(logs[r][j]) for r in rows) / len(rows) if rows else 0.0
    each = [x / len(words) * min(len(words), 24) for x in total]
    each = [math.exp(x - max(each)) for x in each]
    return langs[each.index(max(each))], max(each) / sum(each)


def brute_near(rows):
    """Rows that stay: of rows that 80 % of five-word shingles connect, the first by id and digest; rows without id or words."""
    import xxhash  # noqa: F401

    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w and i is not None else None)
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and top[a] != top[b]:
                old, new = top[a], top[b]
                top = [new if t == old else t for t in top]
    classes = {}
    for n, r in enumerate(rows):
        if sets[n] is not None:
            classes.setdefault(top[n], []).append(r)
    return classes.values(), [r for n, r in enumerate(rows) if sets[n] is None]


def brute_cut(rows):
    """(row, its text after 13-word windows that a smaller id has as well are taken out) for each row that has something left."""
    order = lambda i: -(1 << 63) if i is None else i
    least = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - 12):
            least[tuple(w[p : p + 13])] = min(order(i), least.get(tuple(w[p : p + 13]), order(i)))
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if least[tuple(w[p : p + 13])] < order(r[0]):
                gone[p : p + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        if not any(gone):
            out.append(r)
        elif kept:
            out.append((r[0], kept, *r[2:4], len(kept)))
    return out


def corpus():
    """Texts in two made-up languages with copies, near copies, shared passages, odd rows, rows that share an id or have none."""
    rng = random.Random(23)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)] for lang, letters in (("xx", "abcdefg"), ("yy", "tuvwxyz"))}
    rows = []
    for i in range(60):
        lang = ("xx", "yy")[i % 2]
        t = " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 90)))
        rows.append((i, t, lang if i % 5 else None, ("s", "t", None)[i % 3], len(t)))
    passage = " ".join(rng.choice(vocabulary["xx"]) for _ in range(25))
    more = [(100 + n, rows[n][1]) for n in range(6)]
    more += [(110 + n, " ".join([*rows[n][1].split()[:-1], "abc"])) for n in range(8, 16)]
    more += [(130 + n, f"{rows[n][1]} {passage} {rows[n + 1][1]}") for n in range(20, 26)]
    more += [(150, None), (151, ""), (152, "12 !?"), (153, " \n")]
    # rows that share an id, with other texts and with the same, and rows without one
    more += [(3, f"{passage} {rows[40][1]}"), (3, rows[3][1]), (160, passage), (160, rows[41][1]), (None, rows[5][1]), (None, f"{passage} a b c"), (None, None)]
    return rows + [(i, t, "xx", "s", len(t or "")) for i, t in more]


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.llm import language, mixing, packing

    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = tuples(pipeline.by_language(spark, docs, ""))
    model = language.fit(docs)
    said = [(r, *language_of(model, r[1])) for r in rows]
    assert kept == sorted((r for r, lang, score in said if lang != "und" and score >= 0.5), key=str)
    assert any(r[0] is None for r in kept) and len(kept) < len(rows)

    near = tuples(pipeline.near_duplicates(spark, docs, ""))
    classes, alone = brute_near(rows)
    left = list(near)
    for r in alone:
        left.remove(r)
    assert len(left) == len(classes)
    for members in classes:
        first = min(r[0] for r in members)
        assert sum(r[0] == first and r in members for r in left) >= 1

    assert tuples(pipeline.repeated_passages(spark, docs, "")) == sorted(brute_cut(rows), key=str)

    mixed = tuples(pipeline.source_mix(spark, docs, ""))
    plan = mixing.plan(docs.where("doc_id IS NOT NULL")).collect()
    assert {r[0] for r in mixed} <= {r[0] for r in rows} and plan
    times = mixing.plan(docs).groupBy("id").agg(F.sum("copies").alias("n")).collect()
    assert {r["id"]: r["n"] for r in times if r["n"]} == {i: sum(r[0] == i for r in mixed) for i in {r[0] for r in mixed}}

    # the whole pipeline is its stages, one after the other
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path))
    step = docs
    for _, stage in pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, "").collect(), DOCS)
    want = packing.pack(step)
    piece = ["start", "length", "ids_crc32", "doc_tokens"]
    assert tuples(got.select("doc_id", *piece)) == tuples(want.select("id", *piece))


def test_stages_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_stages_keep_columns_of_any_name(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars int, id string, kept string, carried string, `row` string, `a.b` string, class string, score double"
    rows = [(1, "alpha beta gamma delta", "xx", "s", 22, "i", "k", "c", "r", "ab", "cl", 0.5)]
    docs = spark.createDataFrame(rows, odd)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} == set(rows)
