"""The operators against brute force on small tables that hold nulls, empty texts, ties, copies and clashing columns."""

import hashlib
import random
import zlib
from pathlib import Path

import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import audio, jaccard, language, mixing, ordering, packing, substrings, suffixes, vectors, wrappers

DOCS = "doc_id long, text string, lang string, source string, id string, key string, doc string, n long"


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    out += out[:5]
    for x in out[5:15]:
        w = x.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(40))
    out += [f"{rng.choice(words)} {passage}\n{rng.choice(words)}" for _ in range(12)]
    return [*out, None, "", " \t\n", "a", "aa " * 120, "é" * 150, "x" * 700, "<|endoftext|> A b", passage + " " + passage]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s3"][i % 4], "other", "k", "d", 1) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def odd_ids(rows):
    """Rows that share an id, with equal and with other texts, and rows without one."""
    w = [f"q{i}" for i in range(60)]
    passage = rows[-1][1]
    more = [(1, " ".join(w[:10]) + " " + passage + " " + " ".join(w[10:20])), (1, " ".join(w[20:60])), (1, rows[1][1]), (70, passage), (70, passage + " x"), (None, rows[3][1]), (None, passage), (None, None)]
    return [*rows, *((i, t, "en", "s", "other", "k", "d", 1) for i, t in more)]


def order_of(i):
    return -(1 << 63) if i is None else i


@pytest.mark.parametrize("odd", [False, True])
def test_substrings(spark, rows, odd):
    rows = odd_ids(rows) if odd else rows
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    seen, want = {}, []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - 12):
            seen[tuple(w[p : p + 13])] = min(order_of(i), seen.get(tuple(w[p : p + 13]), order_of(i)))
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for p in range(len(w) - 12):
            if seen[tuple(w[p : p + 13])] < order_of(i):
                gone[p : p + 13] = b"\1" * 13
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    got = substrings.dedup(docs, carry=True).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == sorted(want, key=str)
    assert sorted((str((r["carried"][0], r["text"], *r["carried"][1:])) for r in got)) == sorted(map(str, rows))
    assert all((r["text"] or "").encode().split() == r["kept"].encode().split() for r in got if not r["n_removed"])
    assert substrings.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("odd", [False, True])
def test_suffixes(spark, rows, odd):
    rows = odd_ids(rows) if odd else rows
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    seen, want = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            seen[b[p : p + 100]] = min(order_of(i), seen.get(b[p : p + 100], order_of(i)))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone, here = bytearray(len(b)), set()
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if seen[w] < order_of(i) or w in here:
                gone[p : p + 100] = b"\1" * 100
            here.add(w)
        want.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = suffixes.dedup(docs).collect()
    assert sorted(((r["id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got), key=str) == sorted(want, key=str)
    assert suffixes.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("operator", [substrings, suffixes])
def test_texts_are_shuffled_once(spark, docs, tmp_path, operator):
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for carry in (False, True):
        found = operator.dedup(docs, carry=carry)
        assert len(found.collect()) == docs.count()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan


def test_segments_leave_the_disk(spark, docs):
    import time

    from tidemark.llm import common
    from tidemark.llm import windows as win

    def shuffles():
        return {p.name for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}

    plain, before = win.plain(docs, "doc_id", "text"), shuffles()
    rows = win.settled(plain, substrings.word_units, 13, 5, False, "test")
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert rows.count() > 0
    assert spark.conf.get(common.TIDY, None) is None
    for value in ("true", "false"):
        spark.conf.set(common.TIDY, value)
        assert win.settled(plain, substrings.word_units, 13, 5, False, "test").count() == rows.count()
        assert spark.conf.get(common.TIDY) == value
        spark.conf.unset(common.TIDY)


def test_word_hashes():
    """Equal words have equal hashes wherever they are, different ones different ones; long texts and words too."""
    from tidemark.llm import windows as win

    long = "y" * 70_000
    text = " \t".join(["a", "aa", "b\x00", "é", "\u2003", long, "a", "aa"]) + "\r\x0b\x0c\n"
    filler = " ".join(f"w{i}" for i in range(200_000))
    known: dict = {}
    for data in (text, f"x {text}", f"{filler} {text}", "a\n" * 400_000 + "z" * 600_000 + " " + text, ""):
        words = data.encode().split()
        found = win.word_hashes(data.encode()).tolist()
        assert len(found) == len(words)
        for w, h in zip(words, found, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_settling_across_batches():
    """However rows are cut into batches, the same rows go: kinds and documents that go on are carried over."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import windows as win

    rng = random.Random(9)
    rows = sorted((rng.randint(0, 3), rng.randint(0, 1), rng.randint(0, 3), rng.randint(0, 1), rng.randint(0, 5) << 14 | 1) for _ in range(300))
    names = ["h1", "h2", "doc", "row", "at"]
    for within in (False, True):
        results = []
        for size in (1, 2, 7, 300):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names) for i in range(0, 300, size)]
            results.append(sorted(tuple(r.values()) for b in win.settle(10, within)(batches) for r in b.to_pylist()))
        assert all(r == results[0] for r in results)
        least = {}
        for h1, h2, doc, *_ in rows:
            least[h1, h2] = min(doc, least.get((h1, h2), doc))
        own = {}
        for h1, h2, doc, row, at in rows:
            own[h1, h2, doc, row] = min(at, own.get((h1, h2, doc, row), at))
        want = sum(doc > least[h1, h2] or (within and at > own[h1, h2, doc, row]) for h1, h2, doc, row, at in rows)
        assert sum(r[4] >= 0 for r in results[0]) == want
    assert np.all(win.later(np.zeros(0), *[np.zeros(0)] * 3, True) == np.zeros(0, bool))


def test_sorting_orders_suffixes():
    import numpy as np

    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(400)) + bytes(rng.choice(b"abc") for _ in range(60)) * 5
    starts = np.arange(len(data) - 40)
    order, same = suffixes.sort_suffixes(data, starts, 40)
    got = [data[starts[i] : starts[i] + 40] for i in order]
    assert got == sorted(got) and same.tolist() == [False, *[a == b for a, b in zip(got, got[1:], strict=False)]]


def test_jaccard(spark, docs, rows, monkeypatch):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    # any order of tokens finds the same links
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    assert len(jaccard.frequent(docs.select("text").na.fill(""), 4)) > 0
    assert got == {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert len({c for _, c in got.values()}) < len(got)
    assert jaccard.join(empty(spark)).count() == 0


def test_jaccard_odd_ids(spark):
    """Rows that share an id are apart unless linked; rows without an id are linked with nothing."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, b), (3, a), (None, a), (None, b), (4, ""), (1, a)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r["id"], r["component_id"], r["n_shingles"]) for r in got.collect()), key=str)
    assert found == sorted([(1, 1, 37)] * 3 + [(2, 1, 37), (3, 1, 37), (None, None, 37), (None, None, 37), (4, 4, 0)], key=str)
    assert sorted(r["count"] for r in got.where("class IS NOT NULL").groupBy("class").count().collect()) == [2, 3]


def test_tree_reaches_all_that_bounds_allow():
    import numpy as np

    rng = np.random.default_rng(3)
    points = rng.poisson(1.5, (700, 16)).astype(np.int32)
    sizes = points.sum(axis=1)
    tree = jaccard.CountTree(points, sizes)
    assert len(tree.levels) > 2 and len(tree.levels[-1][1]) == 1
    found = set()
    tree.join(lambda i, js: found.update(tuple(sorted((int(i), int(j)))) for j in js), 85, np.arange(700))
    over = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if 185 * over[i, j] >= 85 * (sizes[i] + sizes[j])}
    assert found == want


def test_jaccard_large_block(spark):
    """A group larger than a split: pivots, splits and what they leave out give the same components as all pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(117)} for i, t in out}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    got = {r["id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def test_mixing(spark, docs, rows):
    got = mixing.plan(docs).collect()
    sizes = {}
    for _, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    targets = {}
    for r in got:
        assert r["size"] == len((rows[r["id"]][1] or "").encode().split()) and r["source_size"] == sizes[rows[r["id"]][3]]
        targets[rows[r["id"]][3]] = r["target"]
        assert r["copies"] in (0, 1, 2)
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    level = [targets[s] / w for s, w in zip(["s1", "s2", "s3", None], [3, 1, 2, 3], strict=True) if targets[s] < 2 * sizes[s] - 1e-9]
    assert max(level, default=0) - min(level, default=0) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs).collect()))
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got) and mixing.mix(docs).columns == docs.columns
    odd = spark.createDataFrame([*rows, *(rows[20],) * 3, *((None, "some words here", "en", "s1", "o", "k", "d", 1),) * 4], DOCS)
    assert mixing.mix(odd).count() == sum(r["copies"] for r in mixing.plan(odd).collect())
    assert mixing.plan(empty(spark)).count() == 0


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, capacity=64).collect()
    places, pieces = {}, {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["id"], []).append(r)
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 64
    for i, text, *_ in rows:
        import numpy as np

        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    total = sum(r["length"] for r in got)
    assert total > 0.9 * 64 * len(places)
    assert packing.pack(empty(spark)).count() == 0


def test_audio(spark, docs, rows):
    got = {r["id"]: r for r in audio.encode(docs).collect()}
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = audio.unwav(bytes(got[i]["media"]))
        assert len(payload) % 576 == 0 and payload and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
        assert got[i]["n_bytes"] == len(data)
    assert got[0]["tensors"] == got[60]["tensors"] and rows[0][1] == rows[60][1]
    assert audio.encode(empty(spark)).count() == 0


def test_resampling_keeps_a_tone():
    import numpy as np

    x = np.sin(2 * np.pi * 500 * np.arange(12000) / 12000).astype(np.float32)
    y = audio.resample(x)
    assert len(y) == 8000 and abs(int(np.abs(np.fft.rfft(y)).argmax()) - 500) <= 1
    assert audio.segments(np.array([-30, -10, -18, -25, -18, -10.0])) == [(1, 3), (5, 6)]


def test_language(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where(F.col("lang") == F.col("lang_pred")).count() >= 0.95 * got.count()
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, "12 !?"), (3, ""), (4, "the of and with that")], "doc_id long, text string")
    said = {r["id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert said[1] == said[2] == said[3] == ("und", 0.0) and said[4][0] == "en" and 0 <= said[4][1] <= 1
    assert language.predict(odd, language.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0
    carried = language.predict(odd.withColumn("lang_pred", F.lit("own")), model, carry=True).collect()
    assert sorted((r["carried"]["doc_id"], r["text"] or "", r["carried"]["lang_pred"]) for r in carried) == [(i, t or "", "own") for i, t in sorted(map(tuple, odd.collect()))]


def test_language_names_and_letters(spark):
    """Languages may be called anything; numbers of any script are no letters."""
    rows = [(i, text, lang) for i in range(30) for text, lang in (("the cat of the house", "k"), ("der hund und das haus", "gram"), ("la casa del perro", "a`b.c"), ("un chat et la maison", "0"))]
    model = language.fit(spark.createDataFrame([(4 * i + j, t, x) for j in range(4) for i, t, x in rows[j::4]], "doc_id long, text string, lang string"))
    assert model["langs"] == ["0", "a`b.c", "gram", "k"]
    odd = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "Ⅷ 3"), (4, "der hund²"), (5, "the² cat")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.predict(odd, model).orderBy("id").collect()] == ["und", "und", "und", "gram", "k"]


def test_wrappers(spark):
    def page(i):
        return f"<html><head><title>t</title><script>var a='<p>';</script></head><body><header>Site</header><div class='menu'><a>Home</a></div><div id=story><div class=c><h2>Head {i}</h2><p>Words of page {i} &amp; more   words<p>Second {i * 7}<br>line</div></div><div>Same text on every page</div><div class='comments'><p>nice {i}</p></div><footer>f</footer></body></html>"

    rows = [(i, "http://h.example/x", page(i)) for i in range(6)] + [(6, None, None), (7, "http://one.example", ""), (8, "bad", "<article><p>A<div class=ad>buy</div><p>B</article><p>not this"), (9, "http://q.example", "plain &lt; text"), (10, "http://q.example", "<p>" * 3000 + "deep")]
    got = {r["id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Head {i}\nWords of page {i} & more words\nSecond {i * 7} line"
    assert got[6] == got[7] == "" and got[8] == "A\nB" and got[9] == "plain < text" and got[10] == "deep"


def test_long_lists_align_in_order():
    import time

    def page(i):
        items = "".join(f"<li><a>{i} item {k}</a></li>" for k in range(1500))
        return f"<html><body><div><p>same words here</p><ul>{items}</ul></div></body></html>"

    began = time.time()
    found = wrappers.induce([page(i) for i in range(3)])
    assert time.time() - began < 5 and found["roots"] == ["html/body/div/ul"] or found["roots"][0].endswith("div")
    deep = ["<div>" * 200 + f"<p>page {i} says</p>" + "<span>fixed</span>" + "</div>" * 200 for i in range(3)]
    assert wrappers.induce(deep)["same"]


def test_two_pages_are_two_exemplars(spark):
    """However two pages of a host hash, both are aligned."""
    rows = [(i, f"http://h{i // 2}.example/{i}", f"<html><body><div>Fixed line of the site</div><div id=x><p>own text {i} {'w' * (i % 7)} and more of it</p></div></body></html>") for i in range(160)]
    found = wrappers.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 80 and all('"roots": []' not in r["wrapper"] for r in found)


def test_wrapper_decides_without_names(spark):
    """Two layouts of a host, neither with an article element nor with telling names: slots are content, constants template."""
    rng = random.Random(4)

    def say(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    rows, want = [], {}
    for i in range(24):
        a, b, c = say(3), say(40), say(20)
        want[i] = f"{a}\n{b}\n{c}"
        if i % 2:
            html = f"<html><body><div class=ka><ul><li>Start</li><li>Shop</li></ul></div><div class=kb><h2>{a}</h2><p>{b}</p><p>{c}</p><p>Printed on paper</p></div><div class=kc><p>All rights kept {i}</p></div></body></html>"
        else:
            html = f"<html><body><table><tr><td class=q>Links</td><td class=z><div><h3>{a}</h3><div>{b}</div><div>{c}</div></div></td></tr></table><table><tr><td class=q>Address of the house</td></tr></table><span>{say(2)}</span></body></html>"
        rows.append((i, "http://h.example/x", html))
    got = {r["id"]: (r["text"], r["induced"]) for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: (x, True) for i, x in want.items()}
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([(r[0], *r[1:], "h", "k", "w", "t") for r in rows + rows[:3]] + [(None, None, rows[1][2], "h", "k", "w", "t")], "page_id long, url string, html string, host string, key string, wrapper string, text string")
    again = wrappers.main_text(clash).collect()
    assert len(again) == 28 and all(r["text"] == want[r["id"]] for r in again if r["id"] is not None)


def test_wrappers_learn_from_all_pages(spark):
    """Of one host's 400 pages four have a layout of their own, six one each, and a line is on nine of ten pages."""
    rng = random.Random(8)

    def say(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    rows, want = [], {}
    for i in range(400):
        a, b = say(30), say(30)
        if i % 100 == 7:
            html = f"<html><body><table><tr><td class=q>Links</td><td class=z><div><h3>{a}</h3><div>{b}</div></div></td></tr></table><span>{say(2)}</span></body></html>"
        elif i % 70 == 3:
            html = f"<html><body><ul class={'u' * i}><li><p><b>{a}</b></p></li></ul><ol class={'o' * i}><li>{b}</li></ol></body></html>"
        else:
            html = f"<html><body><div class=kb><h2>{a}</h2><p>{b}</p>{'<p>Printed on paper</p>' if i % 10 else '<p></p>'}</div><div class=kc><p>All rights kept {i}</p></div></body></html>"
        rows.append((i, "http://h.example/x", html))
        want[i] = (f"{a}\n{b}", i % 70 != 3 or i % 100 == 7)
    rows += [(1000 + i, "http://plain.example", f"only text {i}") for i in range(30)]
    got = {r["id"]: (r["text"], r["induced"]) for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want | {1000 + i: (f"only text {i}", False) for i in range(30)}


def test_vectors_across_shards(spark, monkeypatch):
    """Chains of near vectors over many clusters, few of which a search visits: links by walking, against brute force."""
    import numpy as np

    monkeypatch.setattr(vectors, "PROBES", 2)
    monkeypatch.setattr(vectors, "RECALL", 0.0)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 8))
    x = np.repeat(base, 25, axis=0) + rng.normal(size=(3000, 8)) * 0.22
    x[5] = x[9]
    y = x / np.linalg.norm(x, axis=1)[:, None]
    hit = y @ y.T >= 0.95
    rows = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), "n", "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, node string, near string")).collect()
    got = {r["id"]: r["n_links"] for r in rows}
    true = hit.sum(axis=1) - 1
    assert all(got[i] <= true[i] for i in range(3000)) and sum(got.values()) >= 0.99 * true.sum()
    assert rows[0]["recall"] >= 0.99
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.1, base[:5], base[:5] * 2])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [1.0] * 3), (104, [1.0, None] + [0.0] * 14)]
    y = x / np.linalg.norm(x, axis=1)[:, None]
    hit = y @ y.T >= 0.95
    got = {r["id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i in range(len(x)):
        assert got[i]["n_links"] == hit[i].sum() - 1
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    least = list(range(len(x)))
    while (best := [min(least[j] for j in np.flatnonzero(hit[i])) for i in range(len(x))]) != least:
        least = best
    assert [got[i]["component_id"] for i in range(len(x))] == least
    for i in (100, 101, 102, 103, 104):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_ordering(spark, rows):
    """Shards against sequences made one by one; splits, repeated and null ids do not change the order."""
    import numpy as np
    from tokenizers import Tokenizer

    assert sorted(ordering.permute(np.arange(1000), 1000, 7).tolist()) == list(range(1000))
    t = Tokenizer.from_file(ordering.tokenizer_path())
    rows = [(r[0], r[1], "s") for r in rows] + [(3, "another text " * 300, "s"), (None, "no id " * 400, "s"), (None, None, "s"), (-5, "minus", "s"), (7, rows[7][1], "s")]
    want = []
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 512):
            want.append((i, start, np.array(ids[start : start + 512], "<u2").tobytes()))
    orders = []
    for splits in (2, 5):
        path = ordering.materialise(spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(splits))
        found = ordering.read_shards(spark, path).orderBy("slot").collect()
        assert [r["slot"] for r in found] == list(range(len(want)))
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 2 * r["length"] for r in found)
        orders.append([(r["id"], r["start"], bytes(r["ids"])) for r in found])
        assert ordering.read_shards(spark, path, 10).count() == len(want) - 10
    assert orders[0] == orders[1] and sorted(orders[0], key=str) == sorted(want, key=str)
    assert ordering.read_shards(spark, ordering.materialise(empty(spark))).count() == 0


def test_ordering_shards(spark, docs, rows, monkeypatch):
    """Many shards: they have about the same size, and together the order that one shard has."""
    one = [(r["id"], r["start"]) for r in ordering.read_shards(spark, ordering.materialise(docs)).orderBy("slot").collect()]
    monkeypatch.setattr(ordering, "SHARD", 2000)
    path = ordering.materialise(docs)
    many = ordering.read_shards(spark, path).orderBy("slot").collect()
    assert [(r["id"], r["start"]) for r in many] == one and [r["slot"] for r in many] == list(range(len(one)))
    assert len({r["shard"] for r in many}) > 8
    assert all(r["byte_offset"] % ordering.STRIDE == 0 for r in many)
    last = max(r["slot"] for r in many)
    assert [r["slot"] for r in ordering.read_shards(spark, path, last).collect()] == [last]


def test_ordering_refuses_wide_ids(spark):
    with pytest.raises(Exception, match="two bytes"):
        ordering.materialise(spark.createDataFrame([(1, "a")], "doc_id long, text string"), end_id=70_000)


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.by_language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.count()
    near = p.near_duplicates(spark, docs, sf)
    assert near.count() == jaccard.join(docs).select("component_id").distinct().count()
    cut = p.repeated_passages(spark, docs, sf)
    assert cut.columns == docs.columns
    want = {r["id"]: hashlib.md5(r["kept"].encode()).hexdigest() for r in substrings.dedup(docs).where("n_removed > 0 AND kept <> ''").collect()}
    got = {r["doc_id"]: hashlib.md5(r["text"].encode()).hexdigest() for r in cut.collect()}
    assert all(got[i] == h for i, h in want.items())
    assert p.run(spark, sf).count() > 0
