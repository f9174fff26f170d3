"""Near-duplicates, decontamination, toxicity, urls and archives against plain Python."""

import gzip
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sparselin.llm import decontaminate, near_dup, toxicity, urls, warc
from sparselin.llm.components import components
from sparselin.llm.store import Scratch
from test_texts import WORD


def plain_classes(rows, size, percent):
    """Component by id; rows of one id are one document."""
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        if i is not None and w:
            sets.setdefault(i, []).append({tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))})
    name = {i: i for i in sets}
    find = lambda x: x if name[x] == x else find(name[x])
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                name[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        k, kind = rng.randrange(len(words)), rng.randrange(3)
        words[k:k + 1] = [[f"new{rng.randrange(10**6)}"], [], [words[k], f"more{rng.randrange(10**6)}"]][kind]
    return " ".join(words)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_classes_of_families(spark, prose, odd, size, percent):
    rng = random.Random(3)
    rows = list(odd)
    for family in range(12):
        base = prose(500 + family, 120)
        for k in range(10):
            rows.append((100 + family * 10 + k, edited(base, rng, rng.randrange(0, 9))))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int").repartition(4)
    got = near_dup.near_duplicates(docs, size, percent).collect()
    want = plain_classes(rows, size, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"], r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])


def test_a_bucket_whose_smallest_id_is_no_hub(spark, prose):
    # Neighbours in a chain are links, its ends are not: the star finds some, the blocks the rest.
    words = prose(9, 260).split(" ")
    rows = [(i, " ".join(words[4 * i:4 * i + 180])) for i in range(20)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_classes(rows, 3, 85) == {i: 0 for i in range(20)}


def test_blocks_of_a_large_bucket(spark, prose, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 900)
    words = prose(9, 400).split(" ")
    rows = [(i, " ".join(words[3 * i:3 * i + 180])) for i in range(60)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_classes(rows, 3, 85)


def test_odd_sketch_estimates_high_similarities(spark, prose):
    base = prose(1, 400)
    rng = random.Random(1)
    rows = [(0, base)] + [(k, edited(base, rng, k)) for k in (2, 5, 10, 20)]
    signed = near_dup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    sketch = {r["doc_id"]: np.frombuffer(bytes(r["sketch"]), np.uint64) for r in signed}
    sets = {i: {tuple(t.split(" ")[k:k + 3]) for k in range(len(t.split(" ")) - 2)} for i, t in rows}
    for i in sketch:
        true = len(sets[0] & sets[i]) / len(sets[0] | sets[i])
        assert abs(near_dup.estimate(np.bitwise_count(sketch[0] ^ sketch[i]).sum()) - true) < 0.12


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2), (200, 199)]
    out = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "t")
    got = {r["node"]: r["component"] for r in out.collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "e").count() == 0


@pytest.mark.parametrize("shuffled,steps", [(False, 15), (True, 40)])
def test_components_take_a_logarithm_of_a_path(spark, monkeypatch, shuffled, steps):
    written = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: written.append(name) or table(self, df, name))
    nodes = list(range(1001))
    if shuffled:
        random.Random(4).shuffle(nodes)
    scratch = Scratch(spark, "test")
    out = components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long"), scratch, "t")
    assert {(r["node"], r["component"]) for r in out.collect()} == {(i, 0) for i in range(1001)}
    assert sum("step" in n for n in written) <= steps
    # Only the last names and links are left.
    assert len(list(Path(scratch.root.removeprefix("file:")).iterdir())) <= 2


def test_no_documents(spark, no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert decontaminate.find(no_docs, items).count() == 0
    assert decontaminate.find(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def plain_edits(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_match_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, words = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 25))
        assert decontaminate.edit_match(item, words)[0] == plain_edits(list(item), list(words))


def test_items_with_edits_are_found_and_clean_texts_left_alone(spark, prose, odd):
    rng = random.Random(7)
    items = [(i, prose(3000 + i, 12 + i)) for i in range(30)] + [(90, None), (91, ""), (92, "two words"), (5, prose(3005, 17))]
    rows, planted = list(odd), []
    for i, text in items[:30]:
        for k in range(6):
            edits = min(k, int(0.2 * len(text.split())))
            doc = 1000 + i * 10 + k
            shown = edited(text, rng, edits)
            if k % 2:
                shown = shown.upper().replace(" ", ",  ")
            planted.append((doc, i, len(text.split())))
            rows.append((doc, f"{prose(4000 + doc, 60)} {shown} {prose(5000 + doc, 60)}"))
    rows += [(9000 + k, prose(8000 + k, 200)) for k in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(docs, bench).collect()}
    want = {(d, i) for d, i, _ in planted}
    assert set(found) <= want and len(found) >= 0.97 * len(want)
    texts = dict(rows)
    for (d, i), r in found.items():
        words = "".join(c if c.isalnum() else " " for c in texts[d].lower()).split()
        assert r["distance"] == plain_edits(dict(items[:30])[i].split(), words) <= 0.2 * r["item_words"]
        near = words[max(r["start"], 0):r["start"] + r["item_words"] + r["distance"]]
        assert plain_edits(dict(items[:30])[i].split(), near) == r["distance"]
    left = {r["doc_id"] for r in decontaminate.remove(docs, bench).collect()}
    assert left == {i for i, _ in rows} - {d for d, _ in found}


def test_exact_items_are_always_found(spark, prose):
    items = [(i, prose(100 + i, 10 + i)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    found = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["distance"]) for r in found} == {(i, i, 0, 0) for i, _ in items}


def test_short_items_against_every_pair(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 3, n))
    items = [(10 * n + k, text(n)) for n in range(1, 10) for k in range(6)] + [(95, ""), (96, None), (10, "w3 w3")]
    docs = [(i, text(n)) for i, n in enumerate([*rng.integers(0, 14, 60).tolist(), 40, 60])] + [(100, None), (101, "w1"), (102, "w2")]
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2),
                               spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for d, t in docs:
        for i, x in items:
            own, words = (x or "").split(), (t or "").split()
            if own and (edits := plain_edits(own, words)) <= int(0.2 * len(own)):
                want.append((d, i, edits, len(own)))
    assert {len(x.split()) for i, x in items if any(w[1] == i and w[2] for w in want)} >= {5, 6, 7, 8, 9}
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["item_words"]) for r in found) == sorted(want)
    texts, own = dict(docs), {(i, len((x or "").split())): x for i, x in items}
    for r in found:
        near = texts[r["doc_id"]].split()[r["start"]:][:r["item_words"] + r["distance"]]
        assert plain_edits(own[r["item_id"], r["item_words"]].split(), near) == r["distance"]


def at_full_rate(item, how, rng):
    """As many edits as a match may have: in a row at one end, evenly spaced, at every fifth word, or anywhere."""
    words, n = list(item), len(item) // 5
    even = [(i + 1) * (len(item) + 1) // (n + 1) - 1 for i in range(n)]
    where = {"first": range(n), "last": range(len(item) - n, len(item)), "even": even, "fifth": range(4, len(item), 5),
             "any": sorted(rng.sample(range(len(item)), n))}[how]
    for i, at in reversed(list(enumerate(where))):
        kind = rng.randrange(3) if how == "any" else i % 3
        words[at:at + (kind != 1)] = [] if kind == 2 else [f"new{rng.getrandbits(60)}"]
    return words


@pytest.mark.parametrize("n", [10, 11, 12, 13, 14, 15, 19, 20, 29, 59, 200])
def test_recall_at_the_full_rate(n):
    rng = random.Random(n)
    for how in ("first", "last", "even", "fifth", "any"):
        items = [[f"w{rng.getrandbits(60)}" for _ in range(n)] for _ in range(300)]
        index = decontaminate.index([(i, " ".join(x)) for i, x in enumerate(items)], 0.2, 0.99)
        pad = lambda: [f"p{rng.getrandbits(60)}" for _ in range(20)]
        texts = [" ".join([*pad(), *at_full_rate(x, how, rng), *pad()]) for x in items]
        found = decontaminate.matches(decontaminate.words_of(pa.array(texts), decontaminate.BARE), index, 0.2)
        assert sum(m[0] == m[1] for m in found) >= 0.99 * len(items), (n, how)


def toxic_rows(prose, n):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = prose(10_000 + i, rng.randrange(20, 120)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyterm", "hatefulxx"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxic_rows_are_told_apart(spark, prose, odd_docs, odd):
    rows = toxic_rows(prose, 600)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score", "predicted"]
    held = [(r["predicted"], rows[r["doc_id"]][2]) for r in scored.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.98
    out = toxicity.score(odd_docs, model).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["held_out"] for r in odd_docs.where("doc_id is null").select(toxicity.held_out().alias("held_out")).collect()} == {False}


def test_one_class_only(spark, no_docs):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    for labels, predicted in ([(1, 0), (2, 0)], 0), ([(1, 1), (2, 1), (3, 1)], 1), ([], 0):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {predicted}
    assert toxicity.score(no_docs, model).count() == 0


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def plain_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls(spark):
    seen = [f"http://{s}{d}/{lang}/{i}?q=1#x" for i in range(40) for s in ("", "www.", "m.") for d in ("a.com", "example.com", "b.net", "c.org") for lang in ("en", "es", "fr")]
    seen += [None, "", "no scheme", "://", "HTTP://WWW.Example.COM", "x://Ä.com/É?a#b", "http://com/", "http://xcom/", "a://b://c.com/", "http://a.com/en\n/x", "http://a.com#/y"]
    pages = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(seen)] + [(None, seen[0], "r", 1), (0, seen[0], "r", 1)],
                                  "page_id long, url string, rule string, score int")
    for r in urls.judge(pages, RULES).collect():
        host, path, best = plain_url(seen[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1] if best else None)
        assert r["verdict"] == (best[0] if best else "block" if r["score"] >= 0.5 else "allow")


def test_url_model_learns_the_rules(spark):
    rows = [(h, f"/{p}/{i}", p == "es") for i in range(60) for h in ("a.net", "m.b.net") for p in ("es", "en", "de")]
    table = spark.createDataFrame(rows, "host string, path string, label boolean")
    weights = urls.train(table)
    owner, feature = urls.occurring(["z.net"] * 2, ["/es/1000", "/en/1000"])
    margin = weights[-1] + np.bincount(owner, weights=weights[feature])
    assert margin[0] > 0 > margin[1]
    assert urls.train(table.where("label"))[-1] > 0 > urls.train(table.limit(0))[-1]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_archives(spark, prose):
    same = prose(1, 100)
    rows = [(i, f"http://x/{i}", same if i % 3 == 0 else prose(i, 60)) for i in range(40)]
    rows += [(50, None, None), (51, "http://a\r\nWARC-Type: bad/é", ""), (52, "u", "short"), (53, "u", "short"), (None, "u", same), (None, "u", prose(99, 80)),
             (3, "u2", same), (60, "u", prose(60, 80)), (60, "u", prose(60, 80)), (54, "u", "é" * 60), (70, "u", prose(5, 30_000))]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, kind int").repartition(3)
    scratch = Scratch(spark, "test")
    manifest = scratch.table(warc.write_warc(pages, scratch.path("w"), roll_bytes=2000), "m")
    got = warc.read_warc(spark, scratch.path("w"), manifest).collect()
    want, first = [], {}
    for i, _, h in rows:
        body = (h or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        if i is not None and len(body) >= 100:
            first[digest] = min(first.get(digest, i), i)
    answered = set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (h or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        owner = first.get(digest)
        revisit = digest in first and (owner != i or digest in answered)
        if digest in first and owner == i:
            answered.add(digest)
        want.append((i, len(body), digest, "revisit" if revisit else "response", owner if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    files = sorted(Path(scratch.path("w").removeprefix("file:")).glob("*.warc.gz"))
    assert len(files) == manifest.count() > 8 and not list(files[0].parent.glob(".tmp*"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == len(rows)
    again = warc.write_warc(pages, scratch.path("w2"), roll_bytes=2000)
    assert again.count() == len(files)
    assert [(Path(scratch.path("w2")) / f.name).read_bytes() for f in files] == [f.read_bytes() for f in files]


def test_no_pages_and_damage(spark):
    scratch = Scratch(spark, "test")
    manifest = scratch.table(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), scratch.path("w")), "m")
    assert warc.read_warc(spark, scratch.path("w"), manifest).count() == 0
    good = warc.record(1, "u", "payload", None, False, "2024-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"paYload\r\n"))


def test_bounded_sample_is_the_least_hashes(spark):
    from pyspark.sql import functions as F

    from sparselin.llm.store import bounded_sample
    df = spark.range(5000).withColumnRenamed("id", "k")
    for bound in (10, 700, 6000):
        want = {r["k"] for r in df.orderBy(F.xxhash64("k")).limit(bound).collect()}
        assert {r["k"] for r in bounded_sample(df, ["k"], bound).collect()} == want


def test_decontamination_holds_walks_of_little_text_at_once(spark, monkeypatch):
    import tracemalloc

    from sparselin.llm.store import slices
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(vocabulary, k=1500)) for _ in range(480)]
    items = spark.createDataFrame([(1, " ".join(rng.choices(vocabulary, k=60))), (2, texts[7][:300])], "item_id long, text string")
    asked = []
    monkeypatch.setattr(decontaminate, "map_batches", lambda df, task, schema, size=1 << 22: asked.append((task, size)) or df)
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    decontaminate.remove(docs, items)
    decontaminate.find(docs, items)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    assert batch.nbytes > 3 << 20
    for task, size in asked:
        parts = list(slices(batch, size))
        tracemalloc.start()
        done = [b for part in parts for b in task(part)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24 << 20
        assert sum(b.num_rows for b in done) in (1, len(texts) - 1)


def test_toxicity_fit_reads_written_rows(spark, prose, monkeypatch):
    """Rows that a Python worker makes while another packs them keep twice the workers, with their memory."""
    given, fit = [], toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda rows, *a, **k: (given.append(rows), fit(rows, *a, **k))[1])
    rows = toxic_rows(prose, 100)
    toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
                   spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "parquet" in plan.lower()
