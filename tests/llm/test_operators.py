"""Each operator against a plain version, and on awkward rows."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidewell.llm import bpe_trie, chat_collapse, decontaminate, language_id, lattice_links, near_copies, token_pack, toxicity, url_ratio, warc_zstd  # noqa: E402
from tidewell.llm.queries import END_ID, URL_RULES, VOCABULARY  # noqa: E402
from tidewell.llm.shared import connected, work_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, h int, values string, a int, label string"
#: White space of all kinds, special tokens, empty, null and very long texts, repeated rows and a null id.
TEXTS = [
    None, "", " ", "  a b", "x\n\n  y  ", "it's we'll 'S 's", "<|endoftext|> hi<|endoftext|>  x ", "  a b　 c", "日本語 テキスト 😀 é é", "12 345 $$$ ### .\n.\nA",
    "\x1c a \x85b  \x1f c", "a ​b", "tab\tx \ty", "trail  \n", "one two three four", "One TWO three four", "a" * 5000, "word " * 3000, " ".join(f"w{i}" for i in range(20000)),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "clash", i, "v", -i, "L") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[9], (None, "one two three four", None, 0, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# op1


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing_round_trips(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, np.uint64)
    for n in (0, 1, 7, 8, 1003):
        assert (token_pack.unpack(token_pack.pack(ids[:n], bits), n, bits) == ids[:n]).all()
        assert len(token_pack.pack(ids[:n], bits)) == -(-n * bits // 8)


def test_random_access(tmp_path):
    rng, path = np.random.default_rng(1), str(tmp_path / "x.twp")
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (5, 0, 300, 1, 77)]
    with open(path, "wb") as out:
        w = token_pack.PackWriter(out, 50257, block_ids=64)
        w.add(np.arange(3), np.ones(3, bool), np.concatenate(docs[:3]), np.array([5, 0, 300]))
        w.add(np.array([7, 9]), np.array([True, False]), np.concatenate(docs[3:]), np.array([1, 77]))
        assert w.close() == (5, 383)
    r = token_pack.PackReader(pa.OSFile(path))
    assert r.bits == 16 and r.doc_ids.tolist() == [0, 1, 2, 7, 9] and r.valid.tolist() == [1, 1, 1, 1, 0]
    for i, d in enumerate(docs):
        assert (r.document(i) == d).all()
    assert (r.ids(100, 200) == np.concatenate(docs)[100:200]).all()


def test_token_files(spark, awkward, none, library):
    docs = awkward.select("doc_id", "text").unionByName(table(spark, "documents").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    files = token_pack.write_packed(docs, work_dir(spark, "t1"), VOCABULARY, END_ID)
    got = sorted(map(tuple, token_pack.read_packed(files, with_ids=True).collect()), key=lambda r: r[1])
    want = {}
    for i, t in docs.collect():
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, END_ID])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda i: -1 if i is None else i)
    start = 0
    for i, at, n, crc, ids in got:
        assert list(ids) in want[i] and (at, n) == (start, len(ids)) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n
    assert len(got) == sum(map(len, want.values()))
    assert token_pack.read_packed(token_pack.write_packed(none, work_dir(spark, "t1"), VOCABULARY, END_ID)).count() == 0


def test_files_without_a_store_go_to_the_default_one(spark, tmp_path, library):
    from tidewell.llm.shared import file_folder

    assert file_folder(spark, str(tmp_path / "x")) == f"file:{tmp_path}/x" and file_folder(spark, f"file://{tmp_path}/y") == f"file://{tmp_path}/y"
    with pytest.raises(ValueError, match="cannot be written"):
        file_folder(spark, "ftp://somewhere/z")
    files = token_pack.write_packed(table(spark, "documents").select("doc_id", "text"), str(tmp_path / "packed"), VOCABULARY, END_ID)
    assert files.first()["path"].startswith(f"file:{tmp_path}/packed/ids/") and token_pack.read_packed(files).count() == 200
    index = warc_zstd.write_warc(table(spark, "pages"), str(tmp_path / "warc"))
    assert index.first()["path"].startswith(f"file:{tmp_path}/warc/") and warc_zstd.read_warc(index).count() == table(spark, "pages").count()


# op2


def brute_links(rows, least=0.98):
    n, links = len(rows), {i: set() for i in range(len(rows))}
    ok = lambda r: r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    for i, j in combinations(range(n), 2):
        a, b = rows[i], rows[j]
        if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], float), np.array(b[1], float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].add(j)
                links[j].add(i)
    return links


def components(links):
    seen = {}
    for i in links:
        if i not in seen:
            stack, group = [i], []
            seen[i] = i
            while stack:
                k = stack.pop()
                group.append(k)
                for m in links[k]:
                    if m not in seen:
                        seen[m] = i
                        stack.append(m)
    return seen


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    near = lambda v, c: c * v + np.sqrt(1 - c * c) * (o := (o := rng.standard_normal(64)) - (o @ v) * v) / np.linalg.norm(o)
    rows = []
    for g in range(12):
        v = rng.standard_normal(64)
        v /= np.linalg.norm(v)
        rows += [(v * (k + 1), g % 3) for k in range(2)] + [(v, g % 3)] + [(near(v, c), g % 3) for c in (0.98, 0.982, 0.985, 0.99, 0.995, 0.97)]
    rows += [(rng.standard_normal(64), 1) for _ in range(60)] + [(np.zeros(64), 1), (rng.standard_normal(3), 1), (np.full(64, np.nan), 1), (rows[0][0], None)]
    out = [(i, [float(np.float32(x)) for x in v], l) for i, (v, l) in enumerate(rows)]
    return out + [(len(out), None, 1), (len(out) + 1, [], 1), (len(out) + 2, [1.0, None], 1), (len(out) + 3, [1.0, float("inf")], 1)]


def test_lattice_links(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    got = {r["vec_id"]: r for r in lattice_links.lattice_links(df, work_dir(spark, "t2"), block=5).collect()}
    want = brute_links(rows)
    comp = components(want)
    assert all(got[i]["n_links"] <= len(want[i]) for i in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(map(len, want.values()))
    wrong = [i for i in want if got[i]["component_id"] != comp[i]]
    assert len(wrong) <= 2 and all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    blocks = {r["vec_id"]: r["n_links"] for r in lattice_links.lattice_links(df, work_dir(spark, "t2")).collect()}
    assert blocks == {i: r["n_links"] for i, r in got.items()}  # cut into blocks or not


def test_lattice_links_of_awkward_rows(spark):
    rng = np.random.default_rng(11)
    v, w = rng.standard_normal(16), rng.standard_normal(16)
    near = v + 0.001 * rng.standard_normal(16)
    rows = [(1, v), (1, v), (2, v), (3, v * 1e200), (4, near * 1e-200), (5, near * 1e-310), (6, w), (6, v * 2), (7, w), (None, w), (None, v), (None, v), (8, rng.standard_normal(16)), (6, None)]
    df = spark.createDataFrame([(i, None if x is None else [float(c) for c in x], "a") for i, x in rows], "vec_id long, embedding array<double>, label string")
    got = [tuple(r) for r in lattice_links.lattice_links(df, work_dir(spark, "t2")).collect()]
    # vectors like v: ids 1 to 6 and two rows without an id; like w: 6, 7 and one without an id
    want = [(1, 7, 1, True)] * 2 + [(i, 7, 1, False) for i in (2, 3, 4, 5)] + [(6, 2, 1, False), (6, 7, 1, False), (7, 2, 1, False), (None, 2, None, True), (None, 7, None, True), (None, 7, None, True), (8, 0, 8, True), (6, 0, 1, False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lattice_links.lattice_links(df.limit(0), work_dir(spark, "t2")).count() == 0
    once = {r["vec_id"]: tuple(r) for r in lattice_links.lattice_links(df.where("vec_id in (2, 3, 8)"), work_dir(spark, "t2")).collect()}
    assert once == {2: (2, 1, 2, True), 3: (3, 1, 2, False), 8: (8, 0, 8, True)}


def test_lattice_recall_and_decoding():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8)) * 2
    cell = lattice_links.nearest_e8(x)
    doubled = np.round(cell * 2).astype(int)
    assert ((doubled % 2 == 0).all(1) | (doubled % 2 == 1).all(1)).all() and (np.round(cell.sum(1)) % 2 == 0).all()
    assert (((x - cell) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius
    near = [np.linalg.norm(c - cell, axis=1) for c in lattice_links.neighbours(x, cell)]
    assert all(np.allclose(n, np.sqrt(2)) for n in near)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((2000, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    ca, cb = lattice_links.codes(a), lattice_links.codes(0.98 * a + np.sqrt(1 - 0.98**2) * o)
    met = np.zeros(2000, bool)
    for t in range(lattice_links.TABLES):
        met |= np.array([lattice_links.meets(ca[i : i + 1], cb[i : i + 1], t)[0, 0] for i in range(2000)])
    assert met.mean() > 0.99


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {x["node"]: x["component"] for x in connected(spark.createDataFrame(edges + [(5, 5)], "a long, b long"), work_dir(spark, "tc")).collect()}
    links = {}
    for a, b in edges:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    assert got == components({k: links[k] for k in sorted(links)})


def test_components_of_chains_in_order(spark):
    chain = spark.range(1, 1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected(chain.union(chain.select(5000 - F.col("a"), 5000 - F.col("b"))), work_dir(spark, "tc"))
    assert {tuple(r) for r in got.collect()} == {(i, 1) for i in range(1, 1001)} | {(i, 4000) for i in range(4000, 5000)}


@pytest.mark.parametrize("last_edges", [0, 40])
def test_components_by_rounds_alone_and_to_a_few_edges(spark, last_edges):
    chain = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1200).select(F.col("id").alias("a"), F.lit(1000).cast("long").alias("b"))
    loops = chain.limit(0).union(spark.createDataFrame([(7, 7), (None, 3), (2000, None)], "a long, b long"))
    got = connected(chain.union(chain.select("b", "a")).union(star).union(loops), work_dir(spark, "tc"), last_edges)
    assert sorted(tuple(r) for r in got.collect()) == sorted({(i, 1) for i in range(1, 301)} | {(i, 1000) for i in range(1000, 1200)})
    assert connected(loops, work_dir(spark, "tc"), last_edges).count() == 0


# op3


def test_archives(spark, tmp_path):
    pages = [(3, "http://a/", "<p>same</p>"), (1, "http://b/\r\nX: y", "<p>same</p>"), (2, None, None), (7, "u", ""), (9, "u", "x" * 300_000), (8, "ü", "é" * 10), (None, "n", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (None, "n", "alone")]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, sha string, first int")
    index = warc_zstd.write_warc(df, work_dir(spark, "t3"))
    got = sorted((tuple(r) for r in warc_zstd.read_warc(index, with_payload=True).collect()), key=str)
    first = {"<p>same</p>": 1, "": 2}
    for page, size, sha, kind, refers, payload in got:
        texts = [h or "" for i, _, h in pages if i == page and len((h or "").encode()) == size]
        assert texts and hashlib.sha1(texts[0].encode()).hexdigest().upper() == __import__("base64").b32decode(sha).hex().upper()
        again = texts[0] in first and page != first[texts[0]]
        assert (kind, refers) == (("revisit", first[texts[0]]) if again else ("response", None))
        assert bytes(payload) == (b"" if again else texts[0].encode())
    assert len(got) == len(pages)
    # a record by its place in the index alone
    row = index.where("page_id = 9").first()
    with open(row["path"].removeprefix("file://"), "rb") as f:
        import struct

        import zstandard

        _, size = struct.unpack("<II", f.read(8))
        held = zstandard.ZstdDecompressor().decompress(f.read(size))
        raw = not held.startswith(b"\x37\xa4\x30\xec")
        known = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
        f.seek(row["offset"])
        assert b"x" * 300_000 in zstandard.ZstdDecompressor(dict_data=known).decompress(f.read(row["length"]))
    all_whole = warc_zstd.read_warc(warc_zstd.write_warc(df, work_dir(spark, "t3"), least_bytes=1000)).where("record_type = 'revisit'").count()
    assert all_whole == 0 and warc_zstd.read_warc(warc_zstd.write_warc(df.limit(0), work_dir(spark, "t3"))).count() == 0


# op4


def test_encoding_like_the_library(spark, awkward, none, library):
    docs = awkward.select("doc_id", "text").unionByName(table(spark, "documents").select("doc_id", "text"))
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in docs.collect()), key=str)
    got = bpe_trie.encode_decode(docs, VOCABULARY, with_ids=True).collect()
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=str) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(list(r["ids"]), skip_special_tokens=False).encode()).hexdigest()
    assert bpe_trie.encode_decode(none, VOCABULARY).count() == 0


def test_words_of_any_bytes():
    bpe, r = bpe_trie.tokenizer(VOCABULARY), random.Random(2)
    words = list({bytes(r.choice(b"aenrst \xc3\xa9\xf0\x9f") for _ in range(r.randrange(1, 14))) for _ in range(800)})
    for w, ids in zip(words, bpe.encode_words(words)):
        assert ids == bpe.merged([bpe.token[bytes([c])] for c in w])
    assert bpe.decode([bpe.token[b"\xf0"]]) == "�"


# op5


def test_url_rules_and_ratio(spark):
    urls = ["http://www.Example.com/en/1", "http://example.com/en/1", "https://a.example.com/de/", "http://x.net/es/1?a#b", "http://x.net/en/1", "x://com", "nothing", None, "http://casino-win.example.org/en/1", "http://news.example.org/en/1", "http://h?x://y/z", "a\nb://h.com/p\nq"]
    df = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)] + [(None, urls[0], "", "")], "page_id long, url string, rule string, host string")
    model = url_ratio.train(table(spark, "pages"))
    got = {r["page_id"]: r for r in url_ratio.judge(df, URL_RULES, model).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(8)] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("example.com", "/en/1", "example.com/en/"), ("a.example.com", "/de/", "com/"), ("x.net", "/es/1", "net/es/"),
        ("x.net", "/en/1", None), ("com", "", None), ("", "", None), ("", "", None),
    ]
    assert (got[0]["verdict"], got[1]["verdict"]) == ("allow", "block") and (got[8]["verdict"], got[9]["verdict"]) == ("block", "allow")
    assert (got[10]["host"], got[10]["path"]) == ("h", "") and (got[11]["host"], got[11]["path"]) == ("h.com", "/p\nq") and got[None]["verdict"] == "allow"
    pages = [r["url"] for r in table(spark, "pages").collect()]
    bad = [u for u in pages if any(t in u for t in url_ratio.REJECTED_TERMS)]
    right = sum((model.score(u.partition("://")[2]) < model.threshold) == (u in set(bad)) for u in pages)
    assert right >= 0.95 * len(pages)
    assert url_ratio.judge(df.limit(0), URL_RULES, url_ratio.train(df.limit(0))).count() == 0


def test_markov_probabilities_sum_to_one():
    m = url_ratio.Markov(["abcab", "abd"])
    for context in ("", "a", "ab", "zab"):
        total = sum(m.probability(context, chr(c)) for c in range(256))
        assert total == pytest.approx(1.0)


def test_url_models_count_all_urls(spark):
    # more of a kind than the 3,000 that a sample once took, and one of over 2,000 characters
    urls = [f"http://{'bets' if i % 2 else 'news'}{i}.org/{i * 7919 % 10007}" for i in range(8000)] + ["http://long.org/" + "ab" * 2000, "http://long.org/" + "ac" * 2000]
    df = spark.createDataFrame([(u,) for u in urls + urls[:50] + [None, ""]], "url string")
    model = url_ratio.train(df)
    held = {r["url"] for r in df.where(F.pmod(F.xxhash64(F.regexp_replace("url", "^http://", "")), F.lit(4)) == 0).collect()}
    for markov, bad, seeds in ((model.accepted, False, url_ratio.SEEDS[0]), (model.rejected, True, url_ratio.SEEDS[1])):
        own = [u.removeprefix("http://") for u in urls if ("bets" in u) == bad and u not in held]
        plain = url_ratio.Markov(own + seeds)
        assert len(own) > (2900 if bad else 2901) and markov.after == plain.after and markov.total == plain.total
    few = url_ratio.train(df, most=2000)
    assert all(0 < sum(map(len, m.after.values())) <= 2000 + sum(map(len, url_ratio.Markov(s).after.values())) for m, s in zip((few.accepted, few.rejected), url_ratio.SEEDS))


def test_url_scores_are_whole_however_few_counts_are_sent(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij\u00e9\u65e5") for _ in range(r.randint(2, 7)))
    urls = [f"http://{'bets' if i % 3 == 0 else 'news'}{word()}.{r.choice(['org', 'net', 'com'])}/{word()}/{word()}" for i in range(400)]
    urls += urls[:30] + [None, "", "x://", "nothing", "a\nb://h.org/p\nq", "http://long.org/" + "ab" * 3000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0])], "page_id long, url string")
    for trained in (df, df.where("page_id % 3 > 0 and page_id < 400")):  # the second has no rejected URLs
        whole, few = url_ratio.train(trained), url_ratio.train(trained, most=300)
        assert whole.table is None and few.table.counts.count() > 300 and few.threshold == whole.threshold
        want, got = (sorted(map(tuple, url_ratio.judge(df, URL_RULES, m).collect()), key=str) for m in (whole, few))
        assert got == want and len(got) == len(urls) + 1
    assert url_ratio.judge(df.limit(0), URL_RULES, few).count() == 0


# op6


def test_chats(spark):
    talks = {
        1: [("user", "hi"), ("assistant", "hello"), ("user", "bye")], 2: [("user", "hi"), ("assistant", "hello")], 3: [("user", "hi")], 4: [("user", "hi"), ("assistant", "hello"), ("user", "bye")],
        5: [("user", "hi"), ("assistant", "other")], 6: [("assistant", "hello")], 7: [(None, None)], None: [("user", "lost")], 8: [("user", f"turn {i}") for i in range(600)],
    }
    rows = [(c, i * 3 - 1, r, t, "x", 1) for c, ts in talks.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows + rows[:3] + [(9, None, "user", "first", "x", 1), (9, 1, "user", "second", "x", 1)], "conv_id long, turn long, role string, text string, h string, place int")
    got = {(r["conv_id"], r["part"]): (r["n_turns"], r["text"]) for r in chat_collapse.format_chats(df, work_dir(spark, "t6")).collect()}
    assert sorted(got, key=str) == sorted([(1, 0), (5, 0), (6, 0), (7, 0), (None, 0), (8, 0), (8, 1), (8, 2), (9, 0)], key=str)
    show = lambda ts: "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in ts)
    assert got[1, 0] == (3, show(talks[1])) and got[7, 0] == (1, show(talks[7])) and got[9, 0][1] == show([("user", "first"), ("user", "second")])
    assert "".join(got[8, k][1] for k in range(3)) == show(talks[8])
    assert chat_collapse.format_chats(df.limit(0), work_dir(spark, "t6")).count() == 0


def test_chats_with_ties_and_long_texts(spark):
    rows = [(1, 1, "user", t) for t in ("c", "a", "b")] + [(2, 1, "user", "x" * 300_000 + e) for e in ("2", "1")] + [(3, 1, "user", t) for t in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["text"] for r in chat_collapse.format_chats(df, work_dir(spark, "t6")).collect()}
    assert got[1] == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in "abc") and set(got) == {1, 2} and len(got[2]) > 600_000


# op7


def brute_contaminated(text, item):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    a, b = words(text), words(item)
    size = min(13, len(b))
    most = 2 if size == 13 else 1 if size >= 7 else 0
    if not size:
        return False
    return any(sum(x != y for x, y in zip(a[i : i + size], b[k : k + size])) <= most for i in range(len(a) - size + 1) for k in range(len(b) - size + 1))


def test_spaced_seeds_hit_every_window():
    assert decontaminate.every_pattern_is_hit()


def test_decontamination(spark, awkward):
    r = random.Random(4)
    vocabulary = [f"wort{i}" for i in range(40)] + ["é", "the", "of"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate((40, 25, 13, 12, 7, 5, 4, 1, 60))] + [(20, None), (21, "")]
    docs = []
    for i in range(80):
        text = [r.choice(vocabulary) for _ in range(r.randrange(0, 80))]
        _, passage = items[r.randrange(9)]
        passage = [w for w in passage.split()]
        for k in r.sample(range(len(passage)), min(len(passage), i % 8)):
            passage[k] = "ersetzt"
        at = r.randrange(len(text) + 1)
        text[at:at] = passage
        docs.append((i, ", ".join(w.upper() if r.random() < 0.3 else w for w in text)))
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string").unionByName(awkward.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.col("label").alias("item_id")))
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    want = {(d, i) for d, t in docs for i, p in items if brute_contaminated(t, p)}
    for block in (decontaminate.BLOCK_BYTES, 200):  # one block, and many
        got = decontaminate.contaminated(df, bench, block_bytes=block).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want
        left = {x["doc_id"] for x in decontaminate.decontaminate(df, bench, block_bytes=block).collect()}
        assert left == {x["doc_id"] for x in df.collect()} - {d for d, _ in want}
    for block in (decontaminate.BLOCK_BYTES, 200):
        assert decontaminate.contaminated(df, bench.limit(0), block_bytes=block).count() == 0 and decontaminate.contaminated(df.limit(0), bench, block_bytes=block).count() == 0


def test_decontamination_of_short_items_and_other_letters(spark):
    filler = "und noch mehr Text davor und danach"
    items = ["ja", "vier Wörter in Folge", "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf", "ΟΔΟΣ ΜΑΣ ΛΟΓΟΣ ΤΙΜΕΣ ΠΟΛΙΣ", "İSTANBUL IŞIK ÇOK GÜZEL BİR ŞEHİR", "a b c d e f g"]
    hits = [(i, f"{filler} {t} {filler}", k) for i, (k, t) in enumerate((k, t) for k, t in enumerate(items))]
    hits += [(10, f"{filler} {items[2].replace('sechs', 'x')} {filler}", 2), (11, items[5].replace("a", "z"), 5), (12, items[5].replace("g", "z"), 5), (13, items[3].lower().replace("ς", "σ"), 3)]
    clean = [(20, "jaja nein"), (21, items[2].replace("sechs", "x").replace("zehn", "y")), (22, "vier Wörter nicht in Folge"), (23, items[5].replace("a", "z").replace("c", "y")), (24, filler)]
    df = spark.createDataFrame([(i, t) for i, t, _ in hits] + clean, "doc_id long, text string")
    for kind in ("smallint", "decimal(9,2)", "string"):
        bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
        for block in (decontaminate.BLOCK_BYTES, 10):
            got = decontaminate.contaminated(df, bench, block_bytes=block)
            assert dict(got.dtypes)["item_id"] == kind
            assert {(r["doc_id"], int(float(r["item_id"]))) for r in got.collect()} == {(i, k) for i, _, k in hits}
    longer = decontaminate.contaminated(df, bench, least_words=5)
    assert {r["doc_id"] for r in longer.collect()} == {i for i, _, k in hits if k not in (0, 1)}


def test_decontamination_of_a_passage_that_all_share(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"a{i} b{i} {passage} c{i}") for i in range(200)]
    docs = [(i, f"{'x ' * (i % 7)}{passage} y{i}") for i in range(30)] + [(100, passage[:30])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for block in (decontaminate.BLOCK_BYTES, 200):
        rows.append(sorted(map(tuple, decontaminate.contaminated(df, bench, block_bytes=block).collect())))
        assert len(rows[-1]) == 30 * 200 and min(r[2] for r in rows[-1]) >= 30
        assert [r["doc_id"] for r in decontaminate.decontaminate(df, bench, block_bytes=block).collect()] == [100]
    assert rows[0] == rows[1]
    index = decontaminate.Index(pa.array([t for _, t in items]))
    words, at = decontaminate.words_of(pa.array([t for _, t in docs]))
    old, decontaminate.CHUNK = decontaminate.CHUNK, 100  # in small steps
    small = index.find(words, at)
    decontaminate.CHUNK = old
    assert all((x == y).all() for x, y in zip(small, index.find(words, at)))


# op8


def test_languages(spark):
    docs = table(spark, "documents")
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model, work_dir(spark, "t8"), "doc_id", F.col("text"), F.lit(None), F.lit(None)).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert rows.where("lang = truth").count() >= 0.98 * docs.count()
    # little text: the other evidence decides
    odd = [(1, "", "de", "h.example.de"), (2, None, None, None), (3, "", None, "h.example.de"), (4, "xq", "fr", None), (None, "Und der die das", None, ""), (6, "", None, "unseen.example.de")]
    more = [(10 + i, t, "de", "h.example.de") for i, t in enumerate(r["text"] for r in docs.where("lang = 'de'").limit(12).collect())]
    df = spark.createDataFrame(odd + more, "doc_id long, text string, declared string, host string")
    got = {r["doc_id"]: r for r in language_id.identify(df, model, work_dir(spark, "t8"), "doc_id", F.col("text"), F.col("declared"), F.col("host")).collect()}
    assert len(got) == len(odd + more)
    assert got[1]["lang"] == "de" and got[3]["lang"] == "de" and got[6]["lang"] == "de" and (got[2]["lang"], got[2]["confidence"]) == ("und", 0.0)
    assert language_id.identify(df.limit(0), model, work_dir(spark, "t8"), "doc_id", F.col("text"), F.col("declared"), F.col("host")).count() == 0
    blank = language_id.fit(docs.limit(0))
    assert {r["lang"] for r in language_id.identify(df, blank, work_dir(spark, "t8"), "doc_id", F.col("text"), F.col("declared"), F.col("host")).collect()} == {"und"}


def plain_languages(model, rows):
    """identify() by dictionaries: rows of (id, text, declared, host)."""
    own = []
    for _, text, _, _ in rows:
        e = model.evidence(pa.array([text or ""], pa.string()))[0]
        q = np.exp(e) / np.exp(e).sum()
        own.append(np.where(e > -language_id.MOST_EVIDENCE, q, 0.0) if e.any() else np.zeros(len(e)))

    def keys(host, declared):
        if host is None or host.replace(".", "").isdigit() or host.startswith("["):
            return [None, None, host, declared]
        return [host.split(".")[-1], ".".join(host.split(".")[-2:]), host, declared]

    sums, everything = [{}, {}, {}, {}], np.sum(own, 0)
    for (_, _, declared, host), q in zip(rows, own):
        for level, k in enumerate(keys(host, declared)):
            if k:
                sums[level][k] = sums[level].get(k, 0) + q
    out = []
    for (i, text, declared, host), q in zip(rows, own):
        prior = (everything - q + 1) / (everything.sum() - q.sum() + len(q))
        for level, k in list(enumerate(keys(host, declared)))[:3]:
            c = np.maximum(sums[level].get(k, np.zeros(len(q))) - q, 0) if k else np.maximum(-q, 0)
            prior = (c + language_id.KAPPA * prior) / (c.sum() + language_id.KAPPA)
        p = prior.copy()
        if declared:
            p = p * (np.maximum(sums[3].get(declared, 0) - q, 0) + 0.05) / (everything + 1)
        if q.any():
            p = p * np.maximum(q, q.max() * np.exp(-language_id.MOST_EVIDENCE))
        p = p / p.sum()
        known = q.any() or declared is not None or host is not None
        best = int(p.argmax())
        out.append((i, model.classes[best] if known and p[best] > language_id.LEAST else "und"))
    return out


def test_languages_like_a_plain_version(spark):
    docs = table(spark, "documents")
    model = language_id.fit(docs.where("doc_id % 4 = 0"))
    r = random.Random(3)
    hosts = ["a.example.de", "b.example.de", "c.example.fr", "10.0.0.1", None]
    rows = [(i, (x["text"] or "")[: r.choice([0, 3, 12, 40, 400])], r.choice([x["lang"], x["lang"], "en", None]), r.choice(hosts)) for i, x in enumerate(docs.collect())]
    rows += rows[:5] + [(None, None, None, None), (900, "12 345 $$$ ###", None, None), (901, "x" * 200_000, "de", None), (902, "qzxj kvqj wzzx qqxz jjvk zxqv " * 20, "de", hosts[0])]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, declared string, host string, domain string, j int")
    got = [(x["doc_id"], x["lang"]) for x in language_id.identify(df, model, work_dir(spark, "t8"), "doc_id", F.col("text"), F.col("declared"), F.col("host")).collect()]
    assert sorted(got, key=str) == sorted(plain_languages(model, rows), key=str)
    assert dict(got)[902] == "und" and dict(got)[None] == "und"


def test_hosts(spark):
    urls = {"http://User:pw@Shop.Example.com:8080/x": ("shop.example.com", "com", "example.com"), "http://10.0.0.1/": ("10.0.0.1", None, None), "http://[::1]:80/": ("[::1]", None, None), "http://a.fr./": ("a.fr", "fr", "a.fr"), "http://:80/": (None, None, None)}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", language_id.bare_host(F.regexp_extract("u", r"(?s)^.*?://([^/?#]*)", 1)).alias("h"))
    suffix, domain = language_id.suffix_and_domain(F.col("h"))
    assert {r["u"]: (r["h"], r["s"], r["d"]) for r in df.select("u", "h", suffix.alias("s"), domain.alias("d")).collect()} == urls


def test_pages_are_read_as_text(spark):
    pages = spark.createDataFrame([(1, "https://a.b.fr/x", "<HTML data-x=1 LANG='fr-CA'><script>var der = 1</script><p>le la&nbsp;les</p><!-- und -->"), (2, None, None)], "page_id long, url string, html string")
    row = pages.select("page_id", language_id.page_text(F.col("html")).alias("t"), language_id.declared_language(F.col("html")).alias("d")).orderBy("page_id").collect()
    assert row[0]["t"].split() == ["le", "la", "les"] and row[0]["d"] == "fr" and row[1]["d"] is None


def test_every_language_has_a_model(spark):
    # 60 languages of words of their own; one has only a long text, one only short ones
    r = random.Random(8)
    words = {k: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for k in range(60)}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    rows = [(k, text(k, 40), f"l{k:02}") for k in range(58) for _ in range(4 if k < 50 else 2)]
    rows += [(58, text(58, 6000), "l58")] + [(59, w, "l59") for w in words[59]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == [f"l{k:02}" for k in range(60)]
    new = spark.createDataFrame([(k, text(k, 30), f"l{k:02}", "h.example") for k in range(60)], "doc_id long, text string, lang string, host string")
    for declared, host in ((F.lit(None), F.lit(None)), (F.col("lang"), F.col("host"))):
        got = language_id.identify(new, model, work_dir(spark, "t8"), "doc_id", F.col("text"), declared, host).collect()
        assert {(x["doc_id"], x["lang"]) for x in got} == {(k, f"l{k:02}") for k in range(60)}


def test_trigrams_are_listed_once_however_texts_are_dealt(spark):
    texts = table(spark, "documents").where("octet_length(text) between 20 and 20000 and lang is not null").select("lang", "text").distinct()
    plain = {}
    for r in texts.collect():
        for code in language_id.grams(pa.array([r["text"]]))[0].tolist():
            plain[r["lang"], code] = plain.get((r["lang"], code), 0) + 1
    for parts in (1, 60):
        dealt = texts.repartition(parts)
        assert {(r["lang"], r["code"]): r["n"] for r in language_id._counted(dealt).where("n > 0").collect()} == plain
        assert language_id._counted_in_parts(dealt).where("n > 0").count() == len(plain)


# op9


def brute_copies(docs):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, grams(t)) for i, t in docs]
    links = {i: set() for i, _ in sets}
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            links[i].add(j)
            links[j].add(i)
    return {i: len(s) for i, s in sets}, components({k: links[k] for k in sorted(links)})


def copies(seed, groups, per_group, n_words, passage):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = [r.choice(words) for _ in range(passage)]
    out = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(n_words)]
        for _ in range(per_group):
            w = list(base)
            for _ in range(r.randrange(0, 1 + n_words // 40)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    out += [" ".join(common + [r.choice(words) for _ in range(r.randrange(5, passage))]) for _ in range(60)]
    out += [out[0]] * 5
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("case", [(1, 12, 4, 60, 30), (2, 1, 90, 60, 40), (3, 2, 50, 400, 60)])
def test_near_copies(spark, case):
    docs = copies(*case)
    size, comp = brute_copies(docs)
    got = {r["doc_id"]: r for r in near_copies.near_copies(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, id string, n int"), work_dir(spark, "t9")).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == size
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


@pytest.mark.parametrize("rows", [1, 7, 40])
def test_near_copies_on_lists_of_many_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(near_copies, "BLOCK", rows)
    docs = copies(4, 2, 45, 60, 60)
    got = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), work_dir(spark, "t9")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_copies(docs)[1]


def test_near_copies_of_awkward_rows(spark, awkward, none):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect() if r["doc_id"] is not None]
    size, comp = brute_copies(sorted(set(rows), key=str))
    got = near_copies.near_copies(awkward, work_dir(spark, "t9")).collect()
    assert len(got) == awkward.count()
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"], r["n_shingles"]) == (None, True, 1)
        else:
            assert (r["n_shingles"], r["component_id"]) == (size[r["doc_id"]], comp[r["doc_id"]])
    assert near_copies.near_copies(none, work_dir(spark, "t9")).count() == 0
    left = {r["doc_id"] for r in near_copies.dedup(awkward, work_dir(spark, "t9")).collect()}
    assert left == {None} | {i for i in comp if comp[i] == i}


def test_near_copies_of_ids_with_several_texts(spark):
    r = random.Random(6)
    a, b, c = ([f"w{r.randrange(500)}" for _ in range(n)] for n in (300, 300, 40))
    change = lambda w, k: " ".join("neu" if i == k else x for i, x in enumerate(w))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (0, " ".join(b)), (2, change(a, 50)), (3, " ".join(a)), (4, change(b, 70)), (5, " ".join(c)), (6, change(c, 0)), (6, ""), (7, ""), (None, " ".join(a)), (8, "short")]
    got = near_copies.near_copies(spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, c string"), work_dir(spark, "t9")).collect()
    want = {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5, 7: 7, 8: 8, None: None}
    assert len(got) == len(rows) and {(x["doc_id"], x["component_id"]) for x in got} == set(want.items())
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_the_estimate_drops_few_linked_pairs():
    from math import ceil, comb

    n, p = near_copies.SKETCH, near_copies.PERCENT / 100
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(ceil(near_copies.LEAST_ESTIMATE * n))) < 1e-6


# op10


def test_toxicity_on_held_out_rows(spark, awkward, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels, work_dir(spark, "t10"))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.fold("doc_id") == 1).select("predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    recall = sum(r["predicted"] for r in got if r["toxic"]) / sum(r["toxic"] for r in got)
    assert right > 0.95 and recall > 0.88
    bad = ["you IDIOT!", "such an idi-ot", "what a s.t.u.p.i.d thing", "a stuppid thing"]
    fine = ["the thing is on the table", "", None, "stup", "1 2 3"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(bad + fine)], "doc_id long, text string, score string")
    p = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert min(p[i] for i in range(4)) > max(p[i] for i in range(4, 9))
    assert toxicity.score(awkward, model).count() == awkward.count() and toxicity.score(none, model).count() == 0
    left = toxicity.without_toxic(df, model)
    assert left.columns == df.columns and left.count() == sum(x < toxicity.CUT for x in p.values())
    blank = toxicity.fit(none, labels.limit(0), work_dir(spark, "t10"))
    assert {r["predicted"] for r in toxicity.score(awkward, blank).collect()} == {0}


def test_the_table_is_the_kernel_decision():
    rng = np.random.default_rng(3)
    marks, words = ["idiot", "worthless", "the", "tisch", "größe", "x1"], ["idiots", "table", "größen", "a", "", "worthles", "i-d-i-o-t", "x" * 32]
    beta = rng.standard_normal(len(marks))
    table = toxicity.as_table(marks, beta, 0.25)
    assert np.allclose(toxicity.margins(words, table)[[i for i, w in enumerate(words) if len(w) > 1]], (toxicity.kernel(words, marks) @ beta + 0.25)[[i for i, w in enumerate(words) if len(w) > 1]], atol=1e-4)

    def plain(a, b):
        def features(w):
            marked, out = f"\0{w}\0", {}
            for places in combinations(range(len(marked)), toxicity.ORDER):
                span = places[-1] - places[0] + 1
                if span <= toxicity.ORDER + toxicity.GAPS:
                    key = tuple(0 if marked[p] == "\0" else int(toxicity.CLASSES[ord(marked[p])]) for p in places)
                    out.setdefault(key, []).append(toxicity.DECAY ** (span - toxicity.ORDER))
            norm = np.sqrt(sum(x * x for xs in out.values() for x in xs))
            return {k: sum(xs) / norm for k, xs in out.items()}

        x, y = features(a), features(b)
        return sum(v * y.get(k, 0) for k, v in x.items())

    for a in ("idiots", "größen", "worthles"):
        for b in marks[:5]:
            assert toxicity.kernel([a], [b])[0, 0] == pytest.approx(plain(a, b), abs=1e-4)


def test_windows_of_texts():
    names, text, unit = toxicity.bags(pa.array(["You are an id iot, s.t.u.p.i.d", None, "", "m o r o n", "y" * 70]))
    of = lambda k: {names[u] for t, u in zip(text, unit) if t == k}
    assert {"you", "arean", "idiot", "s.t.u.p.i.d", "stupid"} <= of(0) and not of(1) and not of(2)
    assert "moron" in of(3) and max(map(len, of(4))) == toxicity.LONGEST


def test_training_needs_no_words_with_labels():
    r = random.Random(1)
    word = lambda: "".join(r.choice("aehinorst") for _ in range(r.randrange(2, 8)))
    text = lambda *more: " ".join(r.sample([*(word() for _ in range(30)), *more], 30 + len(more)))
    rows = [(text(r.choice(["blödmann", "schwachkopf"])), 1) for _ in range(60)] + [(text(), 0) for _ in range(200)]
    table, slope, shift = toxicity.train(pa.array([t for t, _ in rows]), np.array([y for _, y in rows]))
    p = toxicity.scores(pa.array(["der blödmann da", "schwach köpfe", "schwachkopff", text(), text(), ""]), (table, slope, shift))
    assert min(p[0], p[2]) >= toxicity.CUT > max(p[3:])


def test_fold_and_kernel():
    assert [toxicity.crc_fold(i) for i in (0, 1, 2)] == [zlib.crc32(str(i).encode()) % 3 for i in (0, 1, 2)]
    words = ["idiot", "idiots", "table"]
    k = toxicity.kernel(words, words)
    assert k[0, 1] > 0.5 > k[0, 2] and np.allclose(k, k.T, atol=1e-5)
    long = "x" * 200 + "idiot"
    assert any("idiot" in p for p in toxicity.pieces(long)) and max(map(len, toxicity.pieces(long))) <= toxicity.LONGEST
