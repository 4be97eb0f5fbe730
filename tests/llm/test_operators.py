"""The numbered operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, covertree, images, langid, licenses, merkle, mixing, pieces, simhash, tokenstore, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, fp long, row string, component_id long, score double, rid long"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, None, 1, "h", 2, "row", 3, 0.5, 4) for r in rows], DOCS)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base = [words(60, k) for k in range(30)]
    near = [base[0].replace("w", "W", 3), base[1] + "\n", base[2] + " extra"]
    texts = [*base, *near, None, "", "   ", "one", "one two", words(20_000, 99), base[3], base[3]]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]


def groups_of(links, ids):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == groups_of(real, {x for e in real for x in e})
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_simhash(spark, corpus):
    got = {x["doc_id"]: x for x in simhash.near_duplicates(docs(spark, corpus)).collect()}

    def brute(text):
        import xxhash

        w = simhash.lower_ascii(text or "").split()
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {i: brute(t) for i, t, *_ in corpus}
    assert {i: x["fp"] & (1 << 64) - 1 for i, x in got.items()} == fps
    ids = list(fps)
    links = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: x["component_id"] for i, x in got.items()} == groups_of(links, ids)
    kept = simhash.keep_one(docs(spark, [*corpus, (None, "no id", "en", "s")]))
    assert kept.columns == docs(spark, corpus).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*{x["component_id"] for x in got.values()}, None])
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_links_are_whole(spark):
    r = random.Random(1)
    fps = set()
    for _ in range(60):
        f = r.getrandbits(64)
        fps.add(f)
        for k in range(1, 5):
            g = f
            for b in r.sample(range(64), k):
                g ^= 1 << b
            fps.add(g)
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {(x["src"], x["dst"]) for x in simhash.links(spark.createDataFrame(rows, "fp long")).collect()}
    want = {(a, b) for (a,) in rows for (b,) in rows if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


def test_covertree(spark):
    r = np.random.default_rng(0)
    centre = r.normal(size=(6, 16))
    vectors = [c + 0.08 * r.normal(size=16) for c in centre for _ in range(40)] + [r.normal(size=16) for _ in range(60)]
    rows = [(i, int(i % 2), [float(x) for x in v], "x", 1) for i, v in enumerate(vectors)]
    rows += [(1000, 0, rows[0][2], "x", 1), (1001, 0, [2 * x for x in rows[0][2]], "x", 1), (1002, None, rows[0][2], "x", 1), (1003, 0, None, "x", 1), (1004, 0, [0.0] * 16, "x", 1), (1005, 0, [float("nan"), 1.0], "x", 1), (1006, 0, [None, 1.0], "x", 1), (1007, 0, [1.0, 2.0], "x", 1), (1008, 0, [], "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, node string, n long")
    was = covertree.CHUNK
    covertree.CHUNK = 50  # several chunks, nodes and pivots
    try:
        got = {x["vec_id"]: x for x in covertree.near_duplicates(table, 0.95).collect()}
    finally:
        covertree.CHUNK = was
    fine = {i: (lab, np.array(v)) for i, lab, v, *_ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][0] == fine[b][0] and cos(fine[a][1], fine[b][1])]
    n = Counter(x for e in links for x in e)
    assert {i: x["n_links"] for i, x in got.items()} == {i: n[i] for i, *_ in rows}
    assert {i: x["component_id"] for i, x in got.items()} == groups_of(links, [i for i, *_ in rows])
    assert all(x["kept"] == (i == x["component_id"]) for i, x in got.items())
    assert covertree.near_duplicates(table.limit(0)).count() == 0
    # Ids of text, in the order of text.
    named = table.withColumn("vec_id", F.format_string("v%05d", "vec_id"))
    again = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in covertree.near_duplicates(named, 0.95).collect()}
    assert again == {f"v{i:05d}": (x["n_links"], f"v{x['component_id']:05d}", x["kept"]) for i, x in got.items()}


def test_mixing(spark, corpus):
    rows = [(i, t, "en", "big" if i % 2 else (None if i % 3 == 0 else f"s{i}")) for i, t, *_ in corpus]
    got = {x["doc_id"]: x for x in mixing.mix(docs(spark, rows)).collect()}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    assert {i: x["size"] for i, x in got.items()} == size
    total = Counter()
    for i, _, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, clamped = {}, set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in clamped)) / sum(weight[s] for s in order if s not in clamped)
        target = {s: 3 * total[s] if s in clamped else level * weight[s] for s in order}
        over = {s for s in order if target[s] > 3 * total[s]}
        if not over:
            break
        clamped |= over
    taken = Counter()
    for i, _, _, s in rows:
        assert got[i]["target"] == pytest.approx(target[s]) and got[i]["source_size"] == total[s]
        assert size[i] == 0 or got[i]["taken"] % size[i] == 0 and got[i]["taken"] <= 3 * size[i]
        taken[s] += got[i]["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max([size[i] for i, _, _, x in rows if x == s] or [0])
    assert got == {x["doc_id"]: x for x in mixing.mix(docs(spark, rows)).collect()}
    out = mixing.mixed(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: x["taken"] // size[i] for i, x in got.items() if x["taken"]})
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [x["target"] for x in mixing.mix(docs(spark, [(1, None, "en", "a")])).collect()] == [0.0]


def test_tokenstore(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(100, "It's a 'test's I'M. ,x,y. İstanbul éa\x1cb　c 1234 a1,b .,", "en", "s"), (101, None, "en", "s"), (102, "\n\t ", "en", "s"), (None, "no id", "en", "s"), (100, "again", "en", "s")]
    rows = [*corpus, *odd]
    manifest = tokenstore.write_tokens(docs(spark, rows), common.new_path(spark, "test"), path)
    lib = Tokenizer.from_file(path)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows if i != 100}
    got = tokenstore.read_digests(manifest).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    assert [x["doc_id"] for x in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i))
    start = 0
    for x in got:
        assert x["start"] == start
        start += x["n_tokens"]
        if x["doc_id"] != 100:
            want = ids[x["doc_id"]]
            assert (x["n_tokens"], x["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    found = {x["doc_id"]: x["ids"] for x in tokenstore.lookup(manifest, [3, 101]).collect()}
    assert found == {3: ids[3], 101: [2]}
    reader = tokenstore.Reader(manifest.first()["path"])
    with pytest.raises(Exception, match="checksum|decompress"):
        raw = bytearray(reader.file.read_at(int(reader.table[0][0]), 0))
        raw[len(raw) // 2] ^= 255
        reader.frame(0, bytes(raw))
    small = tokenstore.Encoder(path, size=20)
    assert all(small.encode(t) == np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for _, t, *_ in rows[:30])
    assert tokenstore.read_digests(tokenstore.write_tokens(docs(spark, []), common.new_path(spark, "test"), path)).count() == 0


def test_pieces(spark):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    p = pieces.Pieces(model, cache=50)

    def brute(word, literal):
        best, back = [0.0], [None]
        for e in range(1, len(word) + 1):
            s, at = best[e - 1] + p.unknown, (e - 1, -1)
            for b in range(max(0, e - 40), e):
                hit = p.words.get(word[b:e])
                if hit and best[b] + hit[1] > s and not any(b <= k < e for k in literal):
                    s, at = best[b] + hit[1], (b, hit[0])
            best.append(s)
            back.append(at)
        out, e = [], len(word)
        while e:
            b, i = back[e]
            out.append([i] if i >= 0 else p._bytes(word[b]))
            e = b
        return [i for part in reversed(out) for i in part]

    texts = ["", "a", "  two  blanks ", "   ", "\n\n x\n", "lit ▁▁ x", "日本語 テスト ünï", "\0nul x", " lead", "trail  ", "ﬁ😀 émoji👍🏽", "a\tb\r\nc", "x" * 300, "the of and license " * 30, words(300, 5)]
    for t in texts:
        ids = np.frombuffer(p.encode_bytes(t), "<i4").tolist()
        assert p.decode(ids) == t
        body = " " + t if t else ""
        assert ids == brute(body.replace(" ", "▁"), {k for k, c in enumerate(body) if c == "▁"}), t[:40]
    df = spark.createDataFrame([*[(t,) for t in texts], (None,)], "text string")
    out = df.select("text", pieces.encoded(F.col("text"), model).alias("ids"), pieces.digested(F.col("text"), model).alias("d")).withColumn("back", pieces.decoded(F.col("ids"), model)).collect()
    assert all(r["back"] == (r["text"] or "") and r["d"]["exact"] and r["d"]["n_pieces"] == len(r["ids"]) for r in out)


def test_langid(spark):
    alphabet = {"xx": "abcdefg", "yy": "hijklmn", "zz": "aeiouñé"}
    r = random.Random(2)
    rows = []
    for k in range(240):
        lang = "xyz"[k % 3] * 2
        rows.append((k, " ".join("".join(r.choices(alphabet[lang], k=5)) for _ in range(r.choice([3, 40]))), lang, "s"))
    rows += [(900, None, "xx", "s"), (901, "", "xx", "s"), (902, "123 !?", "yy", "s"), (903, "abc abc", None, "s"), (903, "abc abc", None, "s")]
    d = docs(spark, rows)
    out = d.select("doc_id", langid.identified(F.col("text"), langid.model_of(d)).alias("p")).collect()
    got = {x["doc_id"]: x["p"] for x in out}
    held = [(i, lang) for i, _, lang, _ in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all(got[i]["lang_pred"] == lang for i, lang in held)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= x["p"]["score"] <= 1 for x in out) and len(out) == len(rows)
    # The bundle is the sum of bound trigrams.
    v = langid.bundles(["ab"])[0]
    a, b, c = langid.letters()
    grams = [(0, 1, 2), (1, 2, 0)]
    assert (v == sum(a[i].astype(int) * b[j] * c[k] for i, j, k in grams)).all()
    empty = docs(spark, [])
    assert empty.select(langid.identified(F.col("text"), langid.model_of(empty))).count() == 0
    unlabelled = docs(spark, [(1, "abc", None, "s")])
    assert unlabelled.select(langid.identified(F.col("text"), langid.model_of(unlabelled)).alias("p")).first()["p"]["lang_pred"] == "und"


def test_channel():
    counts = np.zeros((28, 28, 28), np.int64)
    for w in ["idiot", "stupid", "moron", "hello", "there", "scum"] * 50:
        s = [0, 0, *map(toxicity.symbol, w), 0]
        for x, y, z in zip(s, s[1:], s[2:], strict=False):
            counts[0 if y == 0 else x, y, z] += 1
    ch = toxicity.Channel(counts)
    for seen, word in [("1d10t", "idiot"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("m0r0n!!", "moron"), ("$cum", "scum"), ("hello", "hello"), ('"there,"', "there"), ("123", "123")]:
        assert ch.restore(seen) == [word], seen
    assert ch.spaced(list("idiot")) == ["idiot"]
    assert toxicity.single_runs("you i d i o t there a".split()) == (["you", "there", "a"], [list("idiot")])

    # Viterbi finds the best of all paths.
    def score(word):
        x, y, s = 0, 0, 0.0
        for c in word + " ":
            z = toxicity.symbol(c)
            s += ch.log[x][y][z]
            x, y = (0, 0) if z == 0 else (y, z)
        return s

    import itertools

    lattice = ch.lattice("m0r1n")
    paths = {"".join(p[0] for p in path): sum(p[1] for p in path) for path in itertools.product(*lattice)}
    assert ch.best(lattice) == max(paths, key=lambda w: score(w) + paths[w])


def test_toxicity(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = words(30, k) + (f" {random.Random(k).choice(['idiot', '1d10t', 'i d i o t', 'scum', 'idiooot'])} " if bad else " ") + words(5, k + 1000)
        rows.append((k, text, "en", "s"))
        labels.append((k, 1, int(bad), "x"))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (None, "scum idiot", "en", "s"), (1002, words(20_000, 7), "en", "s")]
    labels += [(None, 1, 1, "x"), (1, 1, None, "x"), (5000, 0, 0, "x")]
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = {x["doc_id"]: x["score"] for x in d.select("doc_id", toxicity.score_column(d, lab).alias("score")).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    right = [(got[k] >= 0.5) == (k % 4 == 0) for k in held]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5 and got[None] >= 0.5
    one = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    assert all(x["s"] < 0.5 for x in d.select(toxicity.score_column(d, one).alias("s")).collect())
    assert docs(spark, []).select(toxicity.score_column(docs(spark, []), lab)).count() == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES[0][1]
    broken = mit.replace("free of charge", "free of any charge").replace("restriction", "limits")
    texts = [
        "The MIT License, mit-license MIT license", "Apache License; APACHE license", "gnu general public license gnu general public", "cc  by cc/by ccby", "x " * 3000 + "MIT License " + "y " * 3000,
        mit.upper(), broken, "Licensed under the GNU General Public License, version 3.", None, "", "license", "É mit license é", "mit license mit license",
    ]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s"), (None, "cc by", "en", "s")]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    for i, t in [*enumerate(texts), (None, "cc by")]:
        w = licenses.WORD.findall(licenses.lower_ascii(t or ""))
        at = [(k, label) for label, phrase in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        x = by[i]
        want = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({b for _, b in at})))
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == want, t
        assert set(filter(None, x["base_labels"].split(","))) <= set(filter(None, x["labels"].split(",")))
        assert 0 <= x["score"] <= 1
    assert by[5]["labels"] == "mit-terms" and by[5]["score"] == 1.0
    assert by[6]["labels"] == "mit-terms" and 0.8 <= by[6]["score"] < 1  # a word put in and one changed: two diagonals
    assert by[7]["labels"] == "gpl,gpl-3.0"
    assert licenses.scan(docs(spark, [])).count() == 0
    # Every run of words goes into the join, and a row for each text comes out of it.
    sizes = {x["doc_id"]: x["n"] for x in docs(spark, rows[:11]).select("doc_id", F.size(licenses.grams(F.col("text"))["hashes"]).alias("n")).collect()}
    assert sizes == {i: max(0, by[i]["n_words"] - 1) + max(0, by[i]["n_words"] - 4) + 1 for i in range(11)}
    hits = licenses.matched(docs(spark, rows), licenses.template_table(), "doc_id", "text")
    assert hits.where("template < 0").count() == len(rows)


def test_licenses_by_brute_force(spark):
    """Labels and scores against all word runs compared with all template runs."""
    r = random.Random(4)
    every = [*((b, t, licenses.SHORT, True) for b, t in licenses.PHRASES), *((b, t, licenses.LONG, False) for b, t in licenses.TEMPLATES)]
    texts = ["filler " * 3 + " ".join(w for w in licenses.words_of(t) if r.random() > drop) + " end" for _, t, _, _ in every for drop in (0, 0.02, 0.3)]
    texts += [" and ".join(t for _, t in licenses.WHOLE), " ".join(r.choices(licenses.words_of(licenses.WHOLE[0][1]), k=900)), "x " * 40_000 + licenses.WHOLE[1][1]]
    got = {x["doc_id"]: (x["labels"], round(x["score"], 9)) for x in licenses.scan(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        words, found = licenses.words_of(text), []
        for label, template, k, base in every:
            t = licenses.words_of(template)
            runs, votes = {}, {}
            for at in range(len(t) - k + 1):
                runs.setdefault(tuple(t[at : at + k]), []).append(at)
            for pos in range(len(words) - k + 1):
                for at in runs.get(tuple(words[pos : pos + k]), ()):
                    votes.setdefault(pos - at, set()).add(at)
            islands, last = [], None
            for d in sorted(votes):
                if last is None or d - last > (0 if base else licenses.SLACK):
                    islands.append((d, set()))
                islands[-1][1].update(a + j for a in votes[d] for j in range(k))
                last = d
            found += [(base, label, start, len(covered) / len(t)) for start, covered in islands]
        best = {}
        for base, _, start, cover in found:
            best[base, start] = max(cover, best.get((base, start), 0))
        found = [x for x in found if x[0] or x[3] == best[x[0], x[2]]]
        good = [x for x in found if x[3] >= (1 if x[0] else licenses.COVER)]
        score = max([*(min(1.0, x[3]) for x in good), *(x[3] / 2 for x in found if x not in good and not x[0]), 0.0])
        assert got[i] == (",".join(sorted({x[1] for x in good})), round(score, 9)), text[:80]
    assert {x for g, _ in got.values() for x in g.split(",")} >= {"mit-text", "isc-text", "bsd-2-clause", "zlib-text", "unlicense"}


def test_merkle(spark):
    rows = [(i, f"http://x/{i}", "h" * (i * 37 % 900)) for i in range(3000)] + [(None, None, None), (7, "again", ""), (7, "again", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = merkle.archive(pages)
    spots = {x["page_id"]: (x["file"], x["offset"]) for x in a.where("page_id IN (5, 1500, 2999)").collect()}
    broken = a.withColumn("hash", F.when(F.col("page_id") == 5, "0").otherwise(F.col("hash"))).where("coalesce(page_id, 0) <> 1500")
    extra = a.where("page_id = 2999").withColumn("offset", F.col("offset") + 100_000)
    found = merkle.audit(a, broken.unionByName(extra)).collect()
    leaves = {(x["file"], x["start"], x["status"]) for x in found if x["level"] == 0 and x["status"] != "same"}
    f, o = spots[2999]
    assert leaves == {(*spots[5], "changed"), (*spots[1500], "missing"), (f, o + 100_000, "extra")}
    roots = {x["file"]: x["status"] for x in found if x["level"] == merkle.LEVELS + 1}
    assert {f for f, status in roots.items() if status != "same"} == {"pages-0", "pages-23", "pages-46"}
    assert set(roots) == {*(f"pages-{k}" for k in range(47)), "pages-none-" + next(x["hash"] for x in a.where("page_id IS NULL").collect())[:2]}
    assert sum(x["level"] == 0 for x in found) < 600  # only mismatching ranges were opened
    assert {x["status"] for x in merkle.audit(a, a).collect()} == {"same"}
    assert merkle.audit(a.limit(0), a.limit(0)).count() == 0


def test_images(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(24):
        a = np.kron(r.integers(0, 255, (8, 8)).astype(np.uint8), np.ones((8, 8), np.uint8))
        rows.append((i, a.shape[1], a.tobytes(), "x"))
        b = [a[8:56, 5:60], np.clip(a * 0.9 + 10 + r.normal(0, 2, a.shape), 0, 255).astype(np.uint8), np.rot90(a), a][i % 4].copy()
        rows.append((100 + i, b.shape[1], b.tobytes(), "x"))
        want[100 + i] = want[i] = i
    rows += [(500, 3, b"1234", "x"), (501, None, None, "x"), (502, 4, b"", "x"), (None, 8, bytes(64), "x"), (503, 64, bytes(4096), "x")]
    got = images.copies(spark.createDataFrame(rows, "image_id long, width int, pixels binary, node string")).collect()
    assert len(got) == len(rows)
    by = {x["image_id"]: x["component_id"] for x in got}
    assert all(by[i] == i for i in range(24))  # no false links
    assert sum(by[i] == w for i, w in want.items()) >= 46
    assert [by[i] for i in (500, 501, 502, 503, None)] == [500, 501, 502, 503, None]
    assert images.copies(spark.createDataFrame([], "image_id long, width int, pixels binary")).count() == 0


def test_image_crops(spark):
    """Crops that hold a half or a quarter of a larger image link to it, though its strongest corners are elsewhere."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(6):
        tiles = r.integers(0, 255, (24, 24)).astype(float)
        tiles[:, 12:] = 128 + 0.5 * (tiles[:, 12:] - 128)
        a = np.kron(tiles.astype(np.uint8), np.ones((10, 10), np.uint8))
        for k, b in enumerate((a, a[:, 120:], a[120:, 120:], a[37:157, 120:])):
            rows.append((100 * k + i, b.shape[1], b.tobytes()))
    got = {x["image_id"]: x["component_id"] for x in images.copies(spark.createDataFrame(rows, "image_id long, width int, pixels binary")).collect()}
    assert got == {i: i % 100 for i, *_ in rows}


def test_image_classes(spark, monkeypatch):
    """Classes are those that all pairs of images give, matched by brute force; so they are if every bucket is split by further bands."""
    r = np.random.default_rng(6)
    images_ = []
    for i in range(30):
        base = np.kron(r.integers(0, 255, (8, 8)), np.ones((8, 8)))
        images_ += [np.clip(base + np.kron(r.normal(0, s, (8, 8)), np.ones((8, 8))), 0, 255).astype(np.uint8) for s in (0, 3, 6, 9)[: 1 + i % 4]]
    images_ += [np.clip(images_[0] + r.normal(0, 1 + k % 3, (64, 64)), 0, 255).astype(np.uint8) for k in range(40)]  # a large group
    points = [list(images.describe(a).T) for a in images_]
    pairs = [(i, j) for j in range(len(points)) for i in range(j) if images.agree(points[i], points[j])]
    low = groups_of(pairs, range(len(points)))
    # Rows 1000 and up repeat pixels of the others under ids and rows of their own; rows that share an id are one node.
    rows = [(i, 64, a.tobytes(), 1, "x") for i, a in enumerate(images_)] + [(1000 + i, 64, images_[i].tobytes(), 1, "x") for i in range(5)] + [(3, 64, images_[3].tobytes(), 1, "x")]
    table_ = spark.createDataFrame(rows, "image_id long, width int, pixels binary, node int, tag string")
    for most in (images.PAIRS, 0):
        monkeypatch.setattr(images, "PAIRS", most)
        got = images.copies(table_).collect()
        assert len(got) == len(rows) and sum(x["image_id"] == 3 for x in got) == 2
        by = {x["image_id"]: x["component_id"] for x in got}
        assert all(by[1000 + i] == by[i] for i in range(5))
        hit = sum(by[i] == by[j] for i, j in pairs)
        assert hit >= (0.98 if most else 0.9) * len(pairs), (most, hit, len(pairs))
        assert all(low[by[i]] == low[i] for i in range(len(points)))  # nothing linked that brute force doesn't link


def test_image_full_buckets(spark):
    """Images whose corners all look like those of every other image link by their places, though each bucket is full of equal descriptors."""
    r = np.random.default_rng(8)
    looks = r.integers(-(2**62), 2**62, (8, 2))
    points = []
    for _ in range(7):
        x, y = r.integers(0, 400, (2, 8)) * 4
        place = x << 36 | y << 20
        points += [[place, looks[:, 0], looks[:, 1]], [place + (40 << 36), looks[:, 0], looks[:, 1]]]
    pairs = [(i, j) for j in range(14) for i in range(j) if images.agree(points[i], points[j])]
    assert pairs == [(2 * i, 2 * i + 1) for i in range(7)]
    single = spark.createDataFrame([(i, *[v.tolist() for v in p]) for i, p in enumerate(points)], "node long, place array<long>, d0 array<long>, d1 array<long>")
    assert {x["node"]: x["class"] for x in images.links(single).collect()} == {i: i // 2 * 2 for i in range(14)}


def test_image_candidates_in_blocks(spark, monkeypatch):
    """Pairs of images with two votes are those of plain loops, over classes, however images are dealt out and however few pairs vote at a time."""
    r = np.random.default_rng(10)
    at = lambda: int(r.integers(0, 4)) << 36 | 65535 << 20 | int(r.integers(0, 3)) << 12 | int(r.integers(0, 24)) * 15
    tags = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 40)]
    rows = sorted({(tags[min(int(r.integers(0, 40)), int(r.integers(0, 40)))], f"n{k % 30 // 2 if k % 3 else k % 30}", f"n{k % 30}", at()) for k in range(360)})
    low = {}
    for _, c, n, _ in rows:  # one class an image
        low[n] = min(c, low.get(n, c))
    rows = [(t, low[n], n, p, None) for t, _, n, p in rows]
    seen = {}
    for t, c, src, p, _ in rows:
        for u, d, dst, q, _ in rows:
            if t == u and c < d:
                turn = int(((q & 4095) - (p & 4095)) % 360 * images.TURN_BINS / 360 + 0.5) % images.TURN_BINS
                zoom = round(2 * (np.log2(images.SCALES[q >> 12 & 255]) - np.log2(images.SCALES[p >> 12 & 255])))
                seen.setdefault((src, dst), {}).setdefault((turn, zoom), set()).add(q)
    want = {k for k, v in seen.items() if max(map(len, v.values())) >= images.VOTES}
    assert 0 < len(want) < len(seen)
    entries = spark.createDataFrame(rows, "tag long, class string, node string, place long, block int").cache()
    for blocks, least, meetings in ((8, 1 << 20, 1 << 20), (1, 150, 7), (70, 1 << 20, 1)):
        monkeypatch.setattr(images, "BLOCKS", blocks)
        monkeypatch.setattr(images, "ENTRIES", least)
        monkeypatch.setattr(images, "MEETINGS", meetings)
        got = [tuple(x) for x in images._candidates(entries).collect()]
        assert len(got) == len(set(got)) and set(got) == want, (blocks, meetings)
    assert images._candidates(entries.where("false")).collect() == []


def test_image_common_corner(spark, monkeypatch):
    """A corner that all of many unlike images have makes no rows with the square of their number, and copies among them still link."""
    r = np.random.default_rng(11)
    look = lambda n: r.integers(-(2**62), 2**62, (n, 2))
    common_, points = look(1), []
    for k in range(160):
        x, y = r.integers(0, 400, (2, 9)) * 4
        looks = np.concatenate([common_, look(8)])
        points.append([x << 36 | y << 20, looks[:, 0], looks[:, 1]])
        if k % 40 == 0:
            points.append([points[-1][0] + (40 << 36), looks[:, 0], looks[:, 1]])
    want = {i: i for i in range(len(points))} | {41 * k + 1: 41 * k for k in range(4)}
    made = []

    def rows_made(node):
        n = node.metrics().get("numOutputRows")
        if n.isDefined():
            made.append(n.get().value())
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            rows_made(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            rows_made(node.plan())
        for i in range(node.children().size()):
            rows_made(node.children().apply(i))

    def staged(df, tag="stage"):
        if tag == "candidates":
            df.collect()
            rows_made(df._jdf.queryExecution().executedPlan())
        return common.stage(df, tag)

    monkeypatch.setattr(images, "stage", staged)
    single = spark.createDataFrame([(i, *[v.tolist() for v in p]) for i, p in enumerate(points)], "node long, place array<long>, d0 array<long>, d1 array<long>")
    got = {i: i for i in want} | {x["node"]: x["class"] for x in images.links(single).collect()}
    assert got == want
    assert len(points) <= max(made) <= 24 * len(points), made


def test_image_votes_move_once(spark):
    """Votes are those of plain loops, with one shuffle of the pairs of corners."""
    r = np.random.default_rng(9)
    at = lambda: int(r.integers(0, 3)) << 36 | 65535 << 20 | int(r.integers(0, 3)) << 12 | int(r.integers(0, 12)) * 30
    rows = [(int(r.integers(0, 6)), int(r.integers(6, 12)), at(), at() + (65532 << 36)) for _ in range(900)]
    seen = {}
    for src, dst, p, q in rows:
        turn = int(((q & 4095) - (p & 4095)) % 360 * images.TURN_BINS / 360 + 0.5) % images.TURN_BINS
        zoom = round(2 * (np.log2(images.SCALES[q >> 12 & 255]) - np.log2(images.SCALES[p >> 12 & 255])))
        seen.setdefault((src, dst), {}).setdefault((turn, zoom), set()).add(q)
    want = {k: max(map(len, v.values())) for k, v in seen.items()}
    votes = images._voted(spark.createDataFrame(rows, "src long, dst long, p long, q long"))
    assert {(x["src"], x["dst"]): x["n"] for x in votes.collect()} == {k: n for k, n in want.items() if n >= images.VOTES}
    assert votes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_long_disguises():
    counts = np.zeros((28, 28, 28), np.int64)
    for w in ["you", "are", "an", "idiot", "stupid"] * 50:
        s = [0, 0, *map(toxicity.symbol, w), 0]
        for x, y, z in zip(s, s[1:], s[2:], strict=False):
            counts[0 if y == 0 else x, y, z] += 1
    ch = toxicity.Channel(counts)
    said = ["you", "are", "an", "idiot", "you", "are", "stupid"] * 6
    assert ch.restore(".".join("".join(said))) == said
    assert ch.restore("idi" + "o" * 500 + "t") == ["idiot"]
    rest, runs = toxicity.single_runs(["so", *"".join(said), "end"])
    assert rest == ["so", "end"] and [ch.spaced(r) for r in runs] == [said]
    assert len("".join(ch.spaced(list("".join(said) * 100)))) == 100 * len("".join(said))


def test_special_tokens_in_a_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, mine = Tokenizer.from_file(path), tokenstore.Encoder(path)
    for t in ["<|endoftext|>", "a <|startoftext|> b", "it's<|endoftext|>'s <|startoftext|><|endoftext|>. <|EndOfText|>,"]:
        assert mine.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert np.frombuffer(mine.encode("<|endoftext|>"), "<u4").tolist() == [49407]


def test_long_words():
    """A long word among many takes memory for itself, not for all of them, and is segmented as in short blocks."""
    import tracemalloc

    import public_tokenizers

    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(8)
    few = ["".join(r.choices("abcdefghij0123é", k=n)) for n in (1500, 4000, 4095, 4096, 9000)]
    text = " ".join([*(f"w{k}x" for k in range(4000)), *few])
    tracemalloc.start()
    got = p.encode_bytes(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    assert got == b"".join(np.array(p.segment_one("▁" + w), "<i4").tobytes() for w in text.split(" "))
    assert p.decode(np.frombuffer(got, "<i4").tolist()) == text


def test_common_words_are_whole_pieces():
    """Ranks of merges are turned into log probabilities, so that a frequent long piece is worth more than its parts."""
    import public_tokenizers

    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces.ranked([0.0, -1.0, -2.0]) and not pieces.ranked([-1.5, -2.0]) and not pieces.ranked([-1.0, -1.0])
    ids = np.frombuffer(p.encode_bytes("The quick brown"), "<i4").tolist()
    assert [p.raw[i] for i in ids] == [b" The", b" quick", b" brown"]
