"""The ten operators against brute force on small tables with nulls, empty, long and repeated texts."""

import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nluscore.llm import bpe, common, exact_dedup, htmltext, langid, mixing, neighbours, simhash, tokenfile, toxicity, warc
from nluscore.llm.queries import QUERIES, tokenizer_path
from nluscore.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n ", "a", "a  b", "a b", "don't  stop\n\n now  ", "x" * 5000, "é ñ 日本語  　z", "<|endoftext|> a <|endoftext|>",
       "a \x00 b", "one two three four five", "one two three four five", "ONE two three four five ", "   lead", "tail   "]


def docs(spark, texts, **more):
    rows = [(k, t, f"s{k % 3}" if k % 4 else None, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, id string")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, lang string, id string")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("mask", [-1, 3])
def test_exact_dedup_equals_brute_force(spark, mask):
    texts = ODD + ["ab. " * 400, "ab." * 400, ("ab." * 399) + "ac."]
    d = docs(spark, texts).withColumn("recipe", F.lit(1))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(d, mask=mask).collect()}
    norm = {k: "".join((t or "").translate({c: None for c in (9, 10, 11, 12, 13, 32)})) for k, t in enumerate(texts)}
    for k, t in enumerate(texts):
        same = [j for j in norm if norm[j] == norm[k]]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (keep, len(same), keep == k)
        assert got[k].text_sha256 == hashlib.sha256(norm[k].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_sql_queries_match(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SF)
        q = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, q.fetchall())), name


def test_simhash_forest_and_divided_shards(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 5, dtype=np.int64)
    fps = [0, -1]
    for b in base.tolist():
        for _ in range(60):
            x = b
            for bit in rng.integers(0, 63, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    d = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    a = np.array(fps, np.int64).view(np.uint64)
    forest = simhash.Forest(len(a))
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4)
    forest.link(i, j)
    want = {}
    for k in range(len(a)):
        want.setdefault(forest.root(k), []).append(fps[k])
    want = {min(g): sorted(g) for g in want.values() if len(g) > 1}
    for block, leaf in ((8192, 512), (20, 8)):  # whole shards, divided shards and deep trees
        got = {}
        for r in common.components(simhash.link_edges(d, 4, block, leaf)).collect():
            got.setdefault(r.component, []).append(r.node)
        assert {k: sorted(v) for k, v in got.items()} == want


def test_simhash_odd_texts(spark):
    got = {r.doc_id: r for r in simhash.simhash_dedup(docs(spark, ODD)).collect()}
    assert got[0].fingerprint == "0" * 16 and got[0].component_id == 0 == got[1].component_id == got[2].component_id
    assert int(got[3].fingerprint, 16) == xxhash.xxh64_intdigest(b"a", 42)
    assert got[11].component_id == got[12].component_id == got[13].component_id == 11
    assert simhash.simhash_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [0, 4, 1 << 19])
def test_bpe_equals_the_library(spark, tok, hot):
    got = {r.doc_id: r for r in bpe.encode_decode(docs(spark, ODD), tokenizer_path(), hot_words=hot, full=True).collect()}
    for k, t in enumerate(ODD):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids, (k, t)
        assert got[k].decoded == tok.decode(ids, skip_special_tokens=False) and got[k].n_tokens == len(ids)
    assert bpe.encode_decode(empty(spark), tokenizer_path()).count() == 0


def test_words_follow_the_pre_tokenizer(tok):
    b = bpe.bpe(tokenizer_path())
    parts = ["a", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "'s", "<|endoftext|>", "9", "!"]
    for t in map("".join, itertools.product(parts, repeat=3)):
        ids = [i for w in b.words(t) for i in tok.encode(w, add_special_tokens=False).ids]
        assert ids == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003)
    data = tokenfile.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and tokenfile.unpack(data, 1003, bits).tolist() == ids.tolist()


def test_token_files(spark, tok, tmp_path):
    m = tokenfile.write_tokens(docs(spark, ODD), tokenizer_path(), f"file://{tmp_path}/t", file_size=40, block=8)
    got = {r.doc_id: r for r in tokenfile.read_tokens(m, full=True).collect()}
    at = 0
    for k, t in enumerate(ODD):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32, bytes(got[k].ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert tokenfile.token_files(empty(spark), tokenizer_path()).count() == 0


def test_automaton_counts_longest_phrases(spark):
    train = np.frombuffer("abracadabra".encode("utf-32-le"), np.int32)
    m = langid.Model({"x": train})
    text = "abrabracadxab"
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in "abracadabra":
            n += 1
        at, count = at + n, count + 1
    codes = m.codes(np.frombuffer(text.encode("utf-32-le"), np.int32))
    assert m.automata[0].phrases(codes[:, None].astype(np.uint8), np.array([len(codes)])).tolist() == [count]
    assert langid.language_id(empty(spark)).count() == 0


def test_language_id_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    d = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (3, "abc", "en"), (4, "abc", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in langid.language_id(d).orderBy("doc_id").collect()][:2] == ["und", "und"]


def test_language_id_learns_from_whole_distinct_texts(spark):
    """Openings without letters or shared by all texts, one text that holds most rows, and languages of any number teach nothing wrong."""
    rng = np.random.default_rng(2)
    words = {l: ["".join(rng.choice(list(a), rng.integers(2, 8))) for _ in range(60)] for l, a in
             {"de": "enrishatdugäöü", "en": "etaoinshrdlu", "xx": "kqwzjvbpy", "yy": "тоеаинсрв"}.items()}
    rows = []
    for k in range(400):
        l = list(words)[k % 4]
        body = " ".join(rng.choice(words[l], 150))
        rows.append((k, ("0123456789 " * 600 if l == "de" else "the shared opening " * 400) + body, l))
    rows += [(10**6 + k, "repeated " * 50, "xx") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.lang_pred for r in langid.language_id(d).collect() if r.held_out and r.doc_id < 10**6}
    assert sum(got[k] == rows[k][2] for k in got) >= 0.97 * len(got)
    texts = langid.training_texts(d, F.lit(True))
    assert set(texts) == set(words) and all(len(t) <= langid.TRAIN_CHARS for t in texts.values())
    assert sorted(map(tuple, langid.language_id(d).collect()), key=str) == sorted(map(tuple, langid.language_id(d.repartition(7)).collect()), key=str)


def test_bits_equal_a_parse_of_each_lane(spark):
    """Predictions of many texts at once against a parse of each lane of each text by itself, words of any length."""
    rng = np.random.default_rng(4)
    m = langid.Model({l: langid.letters(" ".join("".join(rng.choice(list(a), 5)) for _ in range(300))) for l, a in (("a", "abcdefg"), ("b", "defghij"))})
    texts = [langid.letters("".join(rng.choice(list("abcdefghijk "), n))) for n in (3, 1, 511, 512, 513, 1700)]
    texts = [t for t in texts if len(t)]
    got = m.bits(texts)
    for t, row in zip(texts, got):
        for a, bits in zip(m.automata, row):
            total = 0
            for lo in range(0, len(t), langid.LANE):
                lane = m.codes(t[lo:lo + langid.LANE]).astype(np.uint8)
                total += int(a.phrases(lane[:, None], np.array([len(lane)]))[0])
            assert abs(bits - total * np.log2(a.size) / len(t)) < 1e-12


def test_token_files_with_null_and_repeated_ids(spark, tok, tmp_path):
    rows = [(None, f"null {k}", "c", 1) for k in range(30)] + [(7, "same text", "c", 2)] * 20 + [(7, f"other {k}", "c", 2) for k in range(20)] + [(1, None, "c", 3), (2, "long " * 3000, "c", 4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, path string, ids int")
    got = tokenfile.read_tokens(tokenfile.write_tokens(d, tokenizer_path(), f"file://{tmp_path}/t", file_size=200, block=16), full=True).collect()
    want = sorted((str(i), bytes(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


def test_mixing(spark):
    texts = [None, "", "w " * 700, "v " * 90, "u " * 1500, "v " * 90] + [f"t{k} " * 40 for k in range(60)]
    d = docs(spark, texts)
    a = sorted(map(tuple, mixing.mixed_counts(d).collect()))
    assert a == sorted(map(tuple, mixing.mixed_counts(d).collect())) and len(a) == len(texts)
    assert all(taken <= 3 * size and size == len((texts[k] or "").split()) for k, size, _, _, taken in a)
    assert abs(sum(r[4] for r in a) - sum(r[1] for r in a)) < 4 * mixing.BLOCK * 4
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r[0]: r[4] for r in a if r[4]}
    assert mixing.targets([100, 10, 10], [5, 2, 1]) == [75.0, 30.0, 15.0]
    assert mixing.mixed_counts(empty(spark)).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 1025):
        d = spark.range(n).selectExpr("id", "5L AS key", f"{n}L AS n")
        assert sorted(r.p for r in mixing.permuted(d, "id", "key", "n", "p").collect()) == list(range(n))


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "z" * 200
    rows = [(3, "http://a/\r\nx", big), (1, None, big), (2, "u", None), (4, "u", "s"), (5, "u", "s"), (None, "u", big)]
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    index = warc.write_bundles(p, f"file://{tmp_path}/w", frame_bytes=300, bundle_bytes=900)
    got = {r.page_id: r for r in warc.read_bundles(index, full=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert all(r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest() and r.payload_bytes == len(h or "") for (k, _, h) in rows for r in [got[k]])
    for r in index.collect():  # random access through the index
        assert warc.Bundle(r.path).record(r.frame, r.offset)[0].get("WARC-Page-ID") == (str(r.page_id) if r.page_id is not None else None)
    assert warc.warc_bundles(p.limit(0)).count() == 0


def test_html(spark):
    page = ("<html><head><title>T</title><script>x='<p>'</script></head><body><div class=site-header>H</div><nav><a>n</a></nav>"
            "<article><h1>A&amp;B</h1><p>one\n two<br>three&nbsp;x<p>short</p><div class='ad'>buy</div><blockquote>q <b>w</b></blockquote></article>"
            "<aside>s</aside><section id=comments><p>I think so too, a long comment of a reader here.</p></section><footer>f</footer></body></html>")
    assert htmltext.main_text(page) == "A&B\none two three x\nshort\nq w"
    long = "word " * 60
    flat = f"<div class=menu><a>x</a><a>y</a></div><div id=page><p>{long}<p>{long}</p></div><div class='cookie-notice'>{long}</div>"
    assert htmltext.main_text(flat).count("\n") == 1
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x") == ""
    assert "b" in htmltext.main_text("<p>a <![foo b</p>")
    rows = [(1, "u", page), (2, None, None), (2, None, "")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(htmltext.main_text(page))]


def test_html_keeps_the_whole_article():
    long = "word " * 400
    ends = "<body><nav><a>n</a></nav><div><a>Home</a></div>{}<div><a>Imprint</a></div><footer>f</footer></body>"
    cases = {
        "<div id=content><h1>T</h1><p class=intro>I</p><div class=body><p>{0}</p></div><p>end</p></div>": ["T", "I", long, "end"],
        "<div><h1>T</h1><div class=share>s</div><section><p>{0}</p></section></div>": ["T", long],
        "<h1>T</h1><p>I</p><p>{0}</p><p>{0}</p><p>end</p>": ["T", "I", long, long, "end"],
        "<article><h1>T</h1><p>x {0}</p><article class=comment><p>{0}{0}</p></article></article>": ["T", "x " + long],
        "<article><p>short</p><article><p>{0}</p></article></article>": ["short", long],
        "<main><h1>T</h1><article><p>{0}</p></article></main>": ["T", long],
        "<article><p>one {0}</p></article><article><p>two {0}</p></article>": ["one " + long, "two " + long],
    }
    for html, want in cases.items():
        assert htmltext.main_text(ends.format(html.format(long))).split("\n") == [x.strip() for x in want], html


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeinorst"), 6))
    bad = ["grobian", "lumpen", "schuft"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 5 == 0
        ws = [word() for _ in range(30)]
        for b in rng.choice(bad, 2 * toxic):
            ws.insert(rng.integers(0, len(ws)), b)
        rows.append((k, " ".join(ws)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 100000)]
    d, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    truth = dict(labels)
    held = [k for k in truth if got[k].held_out]
    assert sum(got[k].predicted == truth[k] for k in held) >= 0.98 * len(held)
    assert all(got[k].predicted == 0 for k in (1000, 1001, 1002))
    assert toxicity.toxicity(d, lab.limit(0)).where("predicted = 0").count() == len(rows)


def test_toxicity_learns_the_same_at_every_size(spark):
    """Forty toxic rows with the same three words are caught among 2,000 rows and among 60,000; copies and columns that clash do no harm."""
    rng = np.random.default_rng(9)
    words = np.array(["".join(rng.choice(list("aeinorst"), 6)) for _ in range(3000)])
    for n in (2000, 60000):
        texts = [" ".join(w) for w in words[rng.integers(0, len(words), (n, 12))]]
        toxic = set(rng.choice(n, 40, replace=False).tolist())
        rows = [(k, t + (" grobian lumpen schuft" if k in toxic else ""), 0.5, "clash") for k, t in enumerate(texts)]
        rows += [(n + 1, "one text many times", 0.5, "clash")] * (n // 3)
        d = spark.createDataFrame(rows, "doc_id bigint, text string, score double, y string")
        lab = spark.createDataFrame([(k, int(k in toxic)) for k in range(n + 2)], "doc_id bigint, toxic int")
        got = toxicity.toxicity(d, lab).collect()
        caught = {r.doc_id for r in got if r.predicted}
        assert len(got) == len(rows) and toxic <= caught and len(caught - toxic) <= 0.001 * n, n
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    centre = rng.standard_normal(24)
    rows += [(200 + k, (centre + s * rng.standard_normal(24)).tolist()) for k, s in enumerate(np.linspace(0, 0.3, 90))]
    rows += [(400, rows[3][1]), (401, [2 * x for x in rows[3][1]]), (402, None), (403, [0.0] * 24), (404, [float("nan")] * 24), (405, [1.0]), (406, [])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1))
    good = {k: np.array(v) for k, v in rows if v and len(v) == 24 and np.isfinite(v).all() and any(v)}
    links = {k: {j for j in good if j != k and good[j] @ good[k] / np.linalg.norm(good[j]) / np.linalg.norm(good[k]) >= 0.95} for k in good}
    got = {r.vec_id: r for r in neighbours.near_duplicates(d, leaf=16, block=16, target=1.0).collect()}
    assert len(got) == len(rows)
    for k, _ in rows:
        seen, todo = {k}, [k]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (len(links.get(k, ())), min(seen), min(seen) == k), k
    assert neighbours.near_duplicates(d.limit(0)).count() == 0


def near_groups(rng, sizes, across):
    """Groups of near copies around unit vectors that have the cosine ``across`` with the first one's."""
    base = np.linalg.qr(rng.standard_normal((24, len(sizes))))[0].T
    centres = [base[0]] + [across * base[0] + np.sqrt(1 - across**2) * b for b in base[1:]]
    return [c + 1e-4 * rng.standard_normal(24) for c, n in zip(centres, sizes) for _ in range(n)]


def test_embedding_links_between_groups_of_near_copies(spark):
    # all 8 places of every list go to the own group; the second and third group link with the first alone
    rng = np.random.default_rng(8)
    vecs = near_groups(rng, (12, 10, 30), 0.955) + list(rng.standard_normal((150, 24)))
    m = np.array(vecs) / np.linalg.norm(vecs, axis=1)[:, None]
    near = m @ m.T >= 0.95
    assert near[:12, :52].all() and not near[12:22, 22:52].any()
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id bigint, embedding array<double>")
    for leaf in (16, 256):
        got = {r.vec_id: r for r in neighbours.near_duplicates(d, leaf=leaf, block=16).collect()}
        assert [got[k].n_links for k in got] == [near[k].sum() - 1 for k in got]
        assert all(got[k].component_id == (0 if k < 52 else k) and got[k].kept == (k == 0 or k >= 52) for k in got)


def test_embedding_audit_sees_lost_pairs_beside_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pairs = rng.standard_normal((20, 24))
    vecs = near_groups(rng, (200,), 0) + [v + 0.01 * rng.standard_normal(24) for v in pairs for _ in range(2)]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "vec_id bigint, embedding array<double>")
    seeds = neighbours.seeds
    monkeypatch.setattr(neighbours, "seeds", lambda *a: seeds(*a).where("src < 200 and dst < 200"))
    with pytest.raises(RuntimeError, match="up to 8 links: 0.0000"):
        neighbours.near_duplicates(d, turns=1)
