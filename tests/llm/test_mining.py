"""WARC files, hard negatives, the positional index and clustering with bounds against brute force, on tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import drake, merkle, negatives, postings

VECTORS = "vec_id long, embedding array<float>, label int, block long, id long, x string, cluster int"


def vectors(spark, rows):
    """Vectors with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], VECTORS)


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 64)) / 8
    rows = [(i, [float(np.float32(v)) for v in centres[i % 6] + r.normal(size=64) / 40], int(r.integers(3)) if i % 3 else 1) for i in range(420)]
    rows += [(i + 1000, rows[i][1], rows[i][2]) for i in range(40)]  # ties
    odd = [[], [0.5] * 3, [0.0] * 64, [None] + [0.1] * 63, [math.nan] * 64, [math.inf] + [0.0] * 63, None]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(2100, rows[0][1], None), (None, rows[0][1], 1), (7000, [0.1] * 65, 2)]
    return rows


def fine(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def mined(rows, anchors_of):
    r = [(i, y, [math.floor(256 * c) for c in v]) for i, v, y in rows if i is not None and y is not None and fine(v)]
    out = []
    for i, y, v in r:
        if anchors_of(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in r if j != i)
            for ps, p, _ in [s for s in scored if s[2] == y][:5]:
                inside = [s for s in scored if s[2] != y and 80 * -ps <= 100 * -s[0] <= 100 * -ps]
                out += [(i, p, k, j, -ps, -s) for k, (s, j, _) in enumerate(inside[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "rows_", "line", "chunk"), [(256, 1024, 4, 32), (3, 17, 2, 7), (1, 64, 1, 100)])
def test_negatives(spark, points, monkeypatch, anchors, rows_, line, chunk):
    monkeypatch.setattr(negatives, "ANCHORS", anchors), monkeypatch.setattr(negatives, "ROWS", rows_), monkeypatch.setattr(negatives, "LINE", line)
    rows = negatives.whole(vectors(spark, points))
    got = negatives.hard_negatives(rows, rows.where("id % 50 = 0"), chunk=chunk).collect()
    assert sorted(tuple(r) for r in got) == mined(points, lambda i: i % 50 == 0)


def test_negatives_edges(spark, points):
    rows = negatives.whole(vectors(spark, points))
    assert negatives.hard_negatives(rows, rows.where("false")).count() == 0
    assert negatives.hard_negatives(rows.where("false"), rows.where("false")).count() == 0
    twice = negatives.whole(vectors(spark, points[:60] + points[:60]))  # an id counts once
    want = mined(points[:60], lambda i: i < 9)
    assert sorted(tuple(r) for r in negatives.hard_negatives(twice, twice.where("id < 9")).collect()) == want and want
    named = negatives.whole(vectors(spark, points[:60]), label=F.concat(F.lit("l"), F.col("label")))
    assert sorted(tuple(r) for r in negatives.hard_negatives(named, named.where("id < 9")).collect()) == want
    big = [(i, [1e5 * (i + 1)] * 64, i % 2) for i in range(6)]  # products over 2 ** 53 stay exact
    assert sorted(tuple(r) for r in negatives.hard_negatives(negatives.whole(vectors(spark, big)), negatives.whole(vectors(spark, big))).collect()) == mined(big, lambda i: True)


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v, _ in rows if fine(v) and len(v) == 64]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), m in zip(kept, of, strict=True) if m == n]
            c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[n]
    return sorted((i if i is not None else -1, n, d) for i, d, n in [(i, *near(v)) for i, v in kept]), c


def test_clusters(spark, points, monkeypatch):
    monkeypatch.setattr(drake, "ROWS", 50)
    work: list = []
    members, c = drake.clustered(drake.whole(vectors(spark, points)), work=work)
    want, centroids = plain_clusters(points)
    assert sorted((r["id"] if r["id"] is not None else -1, r["cluster"], r["distance"]) for r in members.collect()) == want
    assert c.tolist() == centroids
    n = len(want)
    assert work[0] == (n, n, n) and work[-1][2] < n / 10 and sum(w[2] for w in work[1:]) < n * 4  # most vectors keep their centroid unseen
    shown = drake.summed(members, c).collect()
    assert {r["inertia"] for r in shown} == {sum(d for *_, d in want)}
    assert all(r["cluster_inertia"] == sum(d for _, k, d in want if k == r["cluster"]) and r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest() for r in shown)


@pytest.mark.parametrize("nearest", [1, 2, 8])
def test_clusters_bounds(spark, nearest):
    r = random.Random(nearest)
    rows = [(i, [r.choice([0.0, 0.001, 0.002, 1.0]) if r.random() < 0.5 else 0.0 for _ in range(64)], 0) for i in range(150)]
    members, c = drake.clustered(drake.whole(vectors(spark, rows)), nearest=nearest)
    want, centroids = plain_clusters(rows)
    assert sorted(tuple(x) for x in members.collect()) == want and c.tolist() == centroids


def test_clusters_edges(spark, points):
    few = points[:3] + points[:3]
    members, c = drake.clustered(drake.whole(vectors(spark, few)))
    want, centroids = plain_clusters(few)
    assert sorted(tuple(x) for x in members.collect()) == want and c.tolist() == centroids
    members, c = drake.clustered(drake.whole(vectors(spark, points[-9:-5])).where("false"))
    assert members.count() == 0 and drake.summed(members, c).count() == 0
    huge = [(i, [2e4 * (i % 5)] * 64, 0) for i in range(20)]
    assert sorted(tuple(x) for x in drake.clustered(drake.whole(vectors(spark, huge)))[0].collect()) == plain_clusters(huge)[0]


DOCS = "doc_id long, text string, term string, n long, segment long, items string"


def split(text):
    return re.findall(postings.WORD, (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, size, slack):
    runs = {(str(i) if i is not None else "", tuple(w[k : k + size])) for i, t in items if (w := split(t)) for k in range(max(1, len(w) - size + 1))}
    seen = {}
    for _, t in docs:
        for w in split(t):
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, t in docs:
        w, hit, exact, near = split(t), set(), set(), set()
        for item, run in runs:
            at = [k for k in range(len(w) - len(run) + 1) if tuple(w[k : k + len(run)]) == run]
            hit |= {k + j for k in at for j in range(len(run))}
            exact |= {item} if at else set()
            if all(x in seen for x in run):
                anchor = min(range(len(run)), key=lambda j: (seen[run[j]], j))
                if any(all(x in w[max(0, k - anchor + j - slack) : max(0, k - anchor + j + slack + 1)] for j, x in enumerate(run) if j != anchor) for k in range(len(w)) if w[k] == run[anchor]):
                    near.add(item)
        out.append((i, len(w), len(hit), sorted(exact), sorted(near)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    say = lambda n: [r.choice(["The", "of", "a", *[f"w{k}" for k in range(60)]]) for _ in range(n)]
    items = [(f"i{k}", " ".join(say(r.choice([3, 9, 10, 14, 30])))) for k in range(25)] + [("i3", "one more text"), (None, "no id here at all"), ("e", ""), ("n", None), ("p", "... !"), ("dup", "x1 x1 x1 x1"), ("long", " ".join(say(300)))]
    rows = []
    for k in range(120):
        w = say(r.choice([0, 5, 40, 200]))
        for _ in range(r.randrange(3)):
            part = split(r.choice(items)[1])
            part = part[r.randrange(5) :] if len(part) > 12 else part
            if r.random() < 0.4:
                part = [x for x in part if r.random() > 0.08]
            w[len(w) // 2 : len(w) // 2] = part
        rows.append((k if k % 11 else None, "-".join(w)))
    rows += [(5, None), (5, ""), (6, "x1 x1 x1 x1 x1 x1"), (6, "x1 X1é x1"), (7, "x1 x1"), (7, "x1 x1"), (9, "É" * 40), (10, " ".join(say(5000) + split(items[-1][1])))]
    return rows, items


@pytest.mark.parametrize(("segment", "segment_docs", "piece", "block"), [(1 << 21, 1 << 16, 1 << 20, 4096), (300, 50, 200, 40), (1, 1, 1, 1000)])
def test_contaminated(spark, texts, monkeypatch, segment, segment_docs, piece, block):
    for name, v in (("SEGMENT", segment), ("SEGMENT_DOCS", segment_docs), ("PIECE", piece), ("BLOCK", block)):
        monkeypatch.setattr(postings, name, v)
    rows, items = texts
    docs = spark.createDataFrame([(*r, "t", 1, 2, "i") for r in rows], DOCS)
    got = postings.contaminated(docs, spark.createDataFrame(items, "item_id string, text string")).collect()
    want = brute(rows, items, 10, 2)
    assert sorted([(r["id"], r["n_words"], r["n_hit"], r["items"], r["near_items"]) for r in got], key=repr) == want
    assert any(set(near) > set(exact) for *_, exact, near in want)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] and all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_contaminated_edges(spark, texts):
    rows, items = texts
    docs, some = spark.createDataFrame([(*r, "t", 1, 2, "i") for r in rows], DOCS), spark.createDataFrame(items, "item_id string, text string")
    assert postings.contaminated(docs.where("false"), some).count() == 0
    assert {(r["n_hit"], len(r["items"])) for r in postings.contaminated(docs, some.where("false")).collect()} == {(0, 0)}
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert {r["id"] for r in postings.contaminated(named, some).collect()} == {None if i is None else str(i) for i, _ in rows}


def test_packed():
    r = np.random.default_rng(1)
    for values in (np.array([], np.int64), r.integers(0, 1 << 45, 1000), np.array([0, 127, 128, 1 << 14, (1 << 35) - 1])):
        data, ends = postings.packed(values)
        assert len(ends) == len(values) and (postings.unpacked(data.tobytes()) == np.cumsum(values)).all()


def test_token_ids_fuzz():
    """Any mixture of letters, marks, stops, quotes and added tokens has the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm import tokenstore

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, mine, r = Tokenizer.from_file(path), tokenstore.Encoder(path), random.Random(12)
    added = [str(t) for t in lib.get_added_tokens_decoder().values()] if hasattr(lib, "get_added_tokens_decoder") else []
    added = [getattr(t, "content", t) for t in lib.get_added_tokens_decoder().values()] if added else []
    signs = ["İ", "ı", "é", "é", "ñ", "ñ", "ß", "ﬁ", "Å", "Å", "ǅ", "x", "ab", "The", ".", ",", "'", '"', "’", "-", "3", "̇", "あ", "ア", "゙", "가", " ", " ", " ", "\n", "\t", " ", "!", *added]
    texts = ["İ.", "xİ, y", "İİ.", "ȧ.", "é, é.", "ñ.", "é, x.", *["".join(r.choice(signs) for _ in range(r.randrange(1, 14))) for _ in range(6000)]]
    for text in texts:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_token_ids_of_few_stems():
    """The library is asked once for a word, whatever its capitals and the signs after it; the ids are those of the whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.llm import tokenstore

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, mine, asked = Tokenizer.from_file(path), tokenstore.Encoder(path), []
    plain = mine._ids
    mine._ids = lambda pieces: asked.extend(x for p in pieces for x in p.split(" ")) or plain(pieces)
    texts = ["Thingble thingble!! THINGBLE, thingble.", "thingble$$$\x0bÉtudes\x0cétudes.\r\nétudes", None, "", "J\u030c j\u030c J\u030c. <|EndOfText|> <|endoftext|>"]
    want = [np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert mine.encode_batch(texts) == mine.encode_batch(texts) == want
    assert asked.count("thingble") == 1 and sum("hingble" in x.lower() for x in asked) == 1 and sum("tudes" in x for x in asked) == 2
    r, small = random.Random(3), tokenstore.Encoder(path, size=30)
    signs = ["J\u030c", "J", "\u030c", "\u0338", "THE", "Ab", "c", "Σ", "İ", "é", "\x0b", "\x0c", "\x1c", "\x85", "\u3000", " ", " ", "\n", "!!", "$", "'", "'S", "<|", "|>", "<", "=", "_", "7", *lib.get_vocab(with_added_tokens=True).keys() - lib.get_vocab(with_added_tokens=False).keys()]
    for _ in range(60):
        texts = ["".join(r.choice(signs) for _ in range(r.randrange(14))) for _ in range(40)]
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_batch(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_warc_files(spark, tmp_path):
    """Files written, hurt in their bytes, and read: whole records only, and the damage is found where it is."""
    rows = [(i, f"http://x/{i}\r\n\r\nContent-Length: 3", "é" * (i % 50) + ("WARC/1.1\r\nx\r\n\r\n" if i % 9 == 0 else "")) for i in range(200)] + [(None, None, None), (3, None, ""), (3, None, "")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, file string, offset string")
    made = merkle.laid_out(pages.select("page_id", merkle.warc_record(pages).alias("r")).selectExpr("page_id", "cast(octet_length(r) as long) AS length", "sha2(r, 256) AS hash", "substr(r, 1, length(r) - 4) AS record"))
    merkle.write_warc(made.withColumn("replica", F.lit("a")), str(tmp_path / "w"))
    first = merkle.read_warc(spark, str(tmp_path / "w" / "replica=a"))
    key = lambda df: sorted(map(tuple, df.select("file", "offset", "length", "page_id", "hash").collect()), key=str)
    assert key(first) == key(merkle.archive(pages)) and first.count() == 203
    (one,) = (tmp_path / "w" / "replica=a" / "file=pages-1").glob("*.gz")
    data = bytearray(gzip.decompress(one.read_bytes()))
    found = list(merkle.records(bytes(data)))
    assert b"".join(r for _, r in found) == data and len(found) == 64
    other = tmp_path / "b" / "file=pages-1"
    other.mkdir(parents=True)
    data[found[5][0] + 12] ^= 1  # a letter of a header
    data[found[20][0] : found[21][0]] = bytes(found[21][0] - found[20][0])  # a hole
    data[found[40][0] + len(found[40][1]) - 1] = 0  # a record without its end
    (other / "x.gz").write_bytes(gzip.compress(bytes(data)))
    seen = merkle.audit(first.where("file = 'pages-1'"), merkle.read_warc(spark, str(tmp_path / "b"))).collect()
    assert {(x["page_id"], x["status"]) for x in seen if x["level"] == 0 and x["status"] != "same"} == {(69, "changed"), (84, "missing"), (104, "missing")}
    (other / "x.gz").write_bytes(one.read_bytes()[: one.stat().st_size * 2 // 3])
    short = merkle.read_warc(spark, str(tmp_path / "b")).collect()
    assert 0 < len(short) < 64 and {tuple(x) for x in short} <= {tuple(x) for x in first.collect()}


def test_warc_long_files(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FILE_BYTES", 1000)
    pages = spark.createDataFrame([(k, "u", "h" * 300) for k in range(20)] + [(None, "u", "h" * 5000)] * 3, "page_id long, url string, html string")
    got = merkle.archive(pages).groupBy("file").agg(F.min("offset").alias("lo"), F.max(F.col("offset")).alias("hi"), F.count("*").alias("n")).collect()
    assert all(x["lo"] == 0 and x["hi"] < 1000 for x in got) and sum(x["n"] for x in got) == 23 and len(got) > 8


def test_warc_empty(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert merkle.read_warc(spark, str(tmp_path / "none")).count() == 0
