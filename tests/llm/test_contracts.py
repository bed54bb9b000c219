"""Queries against SQL or brute force at a small scale, and the cases that every operator must handle."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import DATA, same
from pyspark.sql import functions as F

from pagewright.llm import bpe, catalog, chat, core, decontaminate, exact_dedup, html_text, jaccard_join, lang_id, pii, substring_dedup, url_filter

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 400
#: Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "n", 5),
    (2, "The quick brown fox jumps over the lazy dog again and again today", "en", None, None),
    (3, "the quick brown fox jumps over the lazy dog again and again today", "en", "n", 1),
    (3, "the quick brown fox jumps over the lazy dog again and again today", "en", "n", 1),
    (4, None, "de", "x", 0), (5, "", None, "x", 0), (6, "  \n\t ", "de", "x", 0), (7, LONG, "de", "y", 9), (8, LONG + "x", "de", "y", 9),
    (None, "mail me at a@b.com or +1 (743) 555-3824", None, None, None), (9, "12345 67890", "en", "z", 2), (10, "ein kurzer text über straßen und häuser", "de", "z", 2),
]
SCHEMA = "doc_id long, text string, lang string, kept string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    source = texts(spark)
    for r in bpe.op2_bpe(spark, DATA).collect():
        ids = t.encode(source[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False)))


def test_bpe_cases(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    path = str(tmp_path / "lexicon")
    bpe.write_lexicon(path, bpe.read_tokenizer(bpe.default_path()), ["the", "there", "then", "hello,", "é"])
    lex = bpe.Lexicon(path)
    for x in ["Hello  World's café 123 don'tve\n你好 É é İ ΣΑΣ <|startoftext|> a<|endoftext|>b", "x" * 3000 + " " + "ab1!" * 300, "\x1c\x85 a", "the then there hello,", ""]:
        ids, bounds, decoded = bpe.encode_batch(lex, [x])
        want = t.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded[0] == t.decode(want, skip_special_tokens=False)
    out = bpe.bpe(docs, bpe.default_path())
    assert out.count() == len(ROWS) and bpe.bpe(none, bpe.default_path()).count() == 0
    assert bpe.decode(out.drop("decoded"), bpe.default_path()).join(out.select("doc_id", F.col("decoded").alias("d")), "doc_id").where("decoded <> d").count() == 0


def test_transducer_holds_its_words_only():
    words = sorted({w.encode() for w in "a an ant ants bat bats cat cats catcher".split()})
    a = bpe.build_transducer(words)
    assert bpe.look_up(a, words).tolist() == list(range(len(words)))
    assert (bpe.look_up(a, [b"", b"b", b"catch", b"antsy", b"x" * 99]) == -1).all()
    assert len(a["finals"]) < sum(map(len, words))


def test_decontaminate_cases(spark, docs, none):
    bench = spark.createDataFrame([(1, "QUICK brown fox jumps over the lazy dog"), (2, "kurzer text"), (None, "12345"), (3, None), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], tuple(r["items"]), r["n_hit"], r["n_words"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert {(1, ("1",), 8, 13), (10, ("2",), 2, 7), (9, (), 1, 2), (4, (), 0, 0)} <= got
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_exact_dedup_cases(docs, none):
    got = defaultdict(set)
    for r in exact_dedup.exact_dedup(docs).collect():
        got[r["doc_id"]].add((r["keep_id"], r["group_size"], r["kept"]))
    assert got[1] == {(3, 3, False)} and got[3] == {(3, 3, True)} and got[2] == {(2, 1, True)} and got[4] == {(5, 2, False)} and got[5] == {(5, 2, True)}
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.where("doc_id = 3").count() == 1 and kept.columns == [c for c in docs.columns if c not in ("kept", "keep_id", "group_size")]


def test_jaccard_cases(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got[1] == got[2] == got[3] == (9, 1) and got[7][1] == got[8][1] == 7 and got[4] == (0, 4) and got[6] == (0, 6) and got[None][1] is None and got[9] == (1, 9)
    assert jaccard_join.jaccard_join(none).count() == 0


@pytest.mark.parametrize("largest, part", [(6, 512), (50_000, 3), (12, 1)])
def test_jaccard_in_small_pieces(spark, monkeypatch, largest, part):
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", 400)
    monkeypatch.setattr(jaccard_join, "LARGEST_BLOCK", largest)
    monkeypatch.setattr(jaccard_join, "BLOCK_PART", part)
    r = np.random.default_rng(3)
    base = [list(map(str, r.integers(0, 10**6, 60))) for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(base[i % 6])
        w[int(r.integers(60))] = f"edit{i}"
        rows.append((i, " ".join(w[: 60 - i % 3])))
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(90))
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    assert got == dict(enumerate(root))


def test_boxes_of_parts_lose_no_pair(spark):
    """Texts of one block, of two size ranges, in parts of a few classes: every pair whose points can link is in one component."""
    r = np.random.default_rng(8)
    sets = []
    for size in (40, 1010, 1200):
        base = r.integers(1, 2**62, size).astype(np.uint64)
        for _ in range(25):
            sets.append(np.unique(np.append(base[r.random(size) > r.choice([0.02, 0.3])], r.integers(1, 2**62, 3).astype(np.uint64))))
    rows = [(i + 1, len(s), jaccard_join.pack_point(s)) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "cls long, n long, point binary")
    members = spark.createDataFrame([(7, i // 6, -(-len(sets) // 6), i + 1, None) for i in range(len(sets))], "block long, part int, parts int, cls long, other long")
    label = {x["node"]: x["root"] for x in core.components(jaccard_join.possible_edges(members, classes)).collect()}
    for a in range(len(sets)):
        for b in range(a):
            if jaccard_join.links(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))):
                assert label[a + 1] == label[b + 1]


def test_wanted_classes_are_joined_once(spark, monkeypatch):
    """The classes whose sets are read come from the shared folder: their joins are not planned again for each use."""
    plans, whole = [], jaccard_join.sets_of
    monkeypatch.setattr(jaccard_join, "sets_of", lambda d, t, k, w: plans.append(w._jdf.queryExecution().optimizedPlan().toString()) or whole(d, t, k, w))
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40)) + f" end{i}") for i in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(6)}
    assert len(plans) == 1 and "Join" not in plans[0]


def test_count_tree_equals_all_pairs():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 400, int(r.integers(5, 300))).astype(np.uint64)) for _ in range(150)]
    sets += [s[1:] for s in sets[:60]]
    link = lambda a, b: bool(jaccard_join.links(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))))
    got = jaccard_join.join_components(np.array([len(s) for s in sets]), lambda i, g: jaccard_join.point(sets[i], g), link)
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if link(a, b) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    assert got.tolist() == root


def test_substring_cases(docs, none):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got[1] == (13, 0) and got[3] == (13, 13) and got[2] == (13, 0) and got[4] == (0, 0) and got[7][1] == 0 and got[8][1] > 4000
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_index_in_batches(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    half = docs.approxQuantile("doc_id", [0.5], 0)[0]
    whole = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs).collect()}
    index = substring_dedup.SubstringIndex(spark)
    parts = [docs.where(F.col("doc_id") <= half / 2), docs.where((F.col("doc_id") > half / 2) & (F.col("doc_id") <= half)), docs.where(F.col("doc_id") > half)]
    got = {}
    for k, part in enumerate(parts):
        got |= {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(part, index=index).collect()}
        index.add(part)
        if k == 1:
            index.compact()
    assert got == whole


def test_windows_of_one_hash_and_other_words_stay(spark):
    """Words of one length that polynomial hashes modulo 2**64 cannot tell apart."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(1 << 10))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(set(core.words(pa.array([a, b])).hashes.tolist())) == 1
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{rest} {a}"), (2, f"{rest} {b}"), (3, f"x {rest}  {a}\ty"), (None, f"{rest} {a}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 13, None: 0}


def test_runs_round_trip():
    r = np.random.default_rng(1)
    h = np.sort(np.concatenate([r.integers(0, 2**63, 500).astype(np.uint64), np.array([2**64 - 1], np.uint64)]))
    d = r.integers(-5, 2**40, 501)
    a, b = substring_dedup.unpack(substring_dedup.pack(h, d))
    assert (a == h).all() and (b == d).all()


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            s = sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
            return 14 <= len(d) <= 19 and s % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, t or "") if ok(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_pii_equals_brute_force(spark, docs, none):
    r = np.random.default_rng(2)
    rows = ["".join(r.choice(list("ab@.1234567 -+()_é😀"), int(r.integers(1, 80)))) for _ in range(600)] + ["9" * 20000, "a." * 5000 + "@b.c", "a@" + "b." * 5000 + "c", "4111 1111 1111 1111", "001.255.0.9", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for x in pii.find_base(df).select("doc_id", pii.joined(F.col("base")).alias("s")).collect():
        assert x["s"] == base_spans(rows[x["doc_id"]])
    source = texts(spark)
    assert all(x["base_sha256"] == sha(base_spans(source[x["doc_id"]])) for x in pii.op8_pii(spark, DATA).collect())
    assert pii.find_pii(docs).count() == len(ROWS) and pii.find_pii(none).count() == 0


def test_pii_terms(spark):
    rows = [(i, f"word{i} filler{i * 7} contact johnny smithson jane@corp.com for x{i} and the y{i * 3}") for i in range(6)] + [(100 + i, f"the for and contact common text number {i}") for i in range(200)]
    got = pii.sanitise(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).where("doc_id = 0").first()
    assert "johnny" not in got["sanitised"] and "jane" not in got["sanitised"] and "contact" in got["sanitised"]


def test_language(spark, docs, none):
    out = lang_id.op9_lang_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_id.identify(docs).collect()}
    assert got[4] == got[5] == got[6] == got[9] == ("und", 0.0) and got[10][0] == "de" and got[1][0] == "en"
    assert lang_id.identify(none).count() == 0


def test_chat_cases(spark):
    rows = [(1, 0, "us\ner", "a<|b\\"), (1, 1, None, None), (None, 0, "assistant", "<|im_end|>\n\\n é"), (1, None, "assistant", "<\\|"), (1, 1, None, None), (2, 0, "assistant", "x" * 200000)]
    f = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in f.collect():
        assert chat.read_turns(r["formatted"].encode()) == [((r["role"] or "").encode(), (r["text"] or "").encode())]
        assert chat.unescape(r["formatted"].encode()[r["loss_start"] : r["loss_end"]]).decode() == (r["text"] if r["role"] == "assistant" else "")
    assert chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_html(spark):
    model = html_text.default_model()
    for source in html_text.labelled_pages(150, seed=99):
        page = html_text.Page(source)
        p = model.marginals(page)
        assert all((p[i] >= 0.5) == (page.label[i] == "1") for i in range(1, len(p)) if page.own[i])
    page = '<nav><ul><li><a href="/">home</a></li></ul></nav><article><h1>T &amp; x</h1><p>one  <b>t</b>wo<br>three<p>fo&eacute;ur <script>"</p>"</script></article><div class="comments"><p>first!</p></div><footer>&copy; me</fo'
    assert html_text.extract(page, model) == "T & x one two three foéur"
    df = spark.createDataFrame([(1, page, "x"), (2, None, None), (3, "", ""), (4, "<" * 5000, ""), (1, page, "x")], "page_id long, html string, text string")
    assert {(r["page_id"], r["n_chars"] > 0) for r in html_text.extract_pages(df).collect()} >= {(1, True), (2, False), (3, False)}
    assert html_text.extract_pages(df.where("false")).count() == 0


def test_tree_marginals_equal_enumeration():
    import itertools
    import math

    model = html_text.default_model()
    page = html_text.Page("<div class=content><h1>a</h1><p>b c</p></div><aside><p>d</p></aside>")
    n = len(page.parent)
    unary = [sum(model.unary.get(f, 0.0) for f in page.features(i)) for i in range(n)]
    total, on = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n - 1):
        y = (0, *y)
        w = math.exp(sum(model.pair.get(page.tag[i], model.pair[""])[y[page.parent[i]]][y[i]] + unary[i] * y[i] for i in range(1, n)))
        total += w
        on = [o + w * v for o, v in zip(on, y, strict=True)]
    assert np.allclose(model.marginals(page)[1:], [o / total for o in on[1:]], atol=1e-9)


def test_urls(spark):
    rows = [(1, None), (2, "nope"), (3, "http://ORG/x"), (4, "a://b?c://d"), (5, ""), (6, "x://example.org/es/?q"), (7, "http://sub.example.org/en/19"), (8, "http://a.com/fr/1"), (9, "http://a.com/de/1"), (9, "http://a.com/de/1")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1][:3] == got[2][:3] == ("", "", None) and got[3] == ("org", "/x", "org/", "allow") and got[4][:2] == ("b", "")
    assert got[6][2:] == ("example.org/es/", "block") and got[7][2:] == ("example.org/en/1", "block") and got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (7, 7)]
    got = {r["node"]: r["root"] for r in core.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 50, 50: 50, 70: 50}


def test_components_of_few_edges_take_few_jobs(spark):
    """Plans of many rounds fill the driver's memory; rounds beyond FEW_EDGES and its end give the same roots."""
    r = np.random.default_rng(4)
    edges = [tuple(x) for x in (r.permutation(3000)[r.integers(0, 3000, (2500, 2))] - 1000).tolist()] + [(i, i + 1) for i in range(5000, 5400)] + [(9999, i) for i in range(6000, 6300)]
    frame, sc = spark.createDataFrame(edges, "a long, b long").repartition(5), spark.sparkContext
    sc.setJobGroup("few", "few")
    got = {x["node"]: x["root"] for x in core.components(frame).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in list(root)}
    assert jobs <= 12
    few, core.FEW_EDGES = core.FEW_EDGES, 300
    try:
        assert {x["node"]: x["root"] for x in core.components(frame).collect()} == got
    finally:
        core.FEW_EDGES = few


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()}
    source = {k: t for k, t in texts(spark).items() if t and any(c.isalpha() for c in t)}
    last = {}
    for k, t in source.items():
        last[t] = max(k, last.get(t, k))
    ids = sorted(last.values())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", source[k].translate(lower))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in ids}
    for a in ids:
        for b in ids:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    ids = [k for k in ids if root[k] == k]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = cut(r["text"])
        for i in range(max(1, len(w) - 7)):
            windows[tuple(w[i : i + 8])].add(r["item_id"])
    hits = {k: set().union(*(windows.get(tuple(w[i : i + 8]), set()) for i in range(len(w)))) for k in ids for w in [cut(source[k])]}
    assert kept == {k for k in ids if len(hits[k]) < 2}


def test_stages_keep_columns_and_handle_cases(spark, docs, none):
    """Nulls, empty and long texts, repeats and clashing names go through every stage but the last."""
    import corpus_pipeline

    names = {"language_id": "score", "exact_dedup": "keep_id", "jaccard_join": "component_id", "decontaminate": "items"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.withColumn(names[name], F.lit("own"))
        out = stage(spark, rows, DATA)
        assert out.columns == rows.columns and {r[0] for r in out.select(names[name]).collect()} == {"own"}
        assert stage(spark, none, DATA).count() == 0
        ids = sorted(str(r["doc_id"]) for r in out.select("doc_id").collect())
        want = {"language_id": "1 10 2 3 3 7 8 None", "exact_dedup": "10 2 3 5 6 7 8 9 None", "jaccard_join": "1 10 4 5 6 7 9 None", "decontaminate": "1 10 2 3 3 4 5 6 7 8 9 None"}
        assert ids == want[name].split()
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, DATA).count() == len(ROWS) and last(spark, none, DATA).count() == 0


def test_language_stage_writes_what_it_found(spark, docs):
    found = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(docs).collect()}
    got = {r["doc_id"]: r["lang"] for r in lang_id.stage_lang_id(spark, docs, DATA).collect()}
    assert got == {k: v for k, v in found.items() if v != "und"} and got[None] in ("de", "en")


def brute_buckets(text):
    out, blank, c = [], False, []
    for ch in text.replace("Σ", "σ").lower():
        if ch.isalpha() or not blank:
            c.append(ord(ch) if ch.isalpha() else 32)
        blank = not ch.isalpha()
    most = 2**64 - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & most
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & most
        return x ^ (x >> 31)

    for n in lang_id.ORDERS:
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + x + 1) & most
            out.append(mix(h + n & most) % lang_id.BUCKETS)
    return out


def test_language_equals_brute_force(spark, monkeypatch):
    import math
    import zlib
    from collections import Counter

    monkeypatch.setattr(lang_id, "PIECE", 7)
    text = "Das ist ein Haus, 12 Häuser... ΣΑΣ!  the İ end --"
    assert Counter(np.concatenate(list(lang_id._buckets(text))).tolist()) == Counter(brute_buckets(text))
    monkeypatch.undo()
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    grams = {r["doc_id"]: Counter(brute_buckets(r["text"] or "")) for r in rows}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    sums = defaultdict(Counter)
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] and any(map(str.isalpha, r["text"] or "")):
            sums[r["lang"]] += grams[r["doc_id"]]
    names = sorted(sums)
    total = {k: sum(sums[k].values()) for k in names}
    got = {r["doc_id"]: r for r in lang_id.op9_lang_id(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == held[r["doc_id"]]
        if not any(map(str.isalpha, r["text"] or "")):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        logs = [sum(n * math.log((sums[k][b] + 0.5) / (total[k] + 0.5 * lang_id.BUCKETS)) for b, n in grams[r["doc_id"]].items()) for k in names]
        top = max(logs)
        assert abs(g["score"] - 1 / sum(math.exp(x - top) for x in logs)) < 1e-3 and g["lang_pred"] == names[logs.index(top)]


def test_benchmark_in_several_passes(spark, monkeypatch):
    want = sorted(map(tuple, decontaminate.op1_decontaminate(spark, DATA).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, decontaminate.op1_decontaminate(spark, DATA).collect())) == want


def other_pages(count, seed=5):
    """(html, words of the article) of pages by a design of their own: div soup, two columns, blog, forum, bare documents."""
    r = np.random.default_rng(seed)
    number = iter(range(10**9))
    say = lambda k: " ".join(f"w{next(number)}" for _ in range(int(r.integers(1, k + 1))))
    out = []
    for i in range(count):
        body, want = [], []

        def p(k=60, tag="p", body=body, want=want):
            t = say(k)
            want.extend(t.split())
            return f"<{tag}>{t}</{tag}>"

        nav = "<ul>" + "".join(f'<li><a href="/{k}">{say(2)}</a></li>' for k in range(int(r.integers(2, 8)))) + "</ul>"
        kind = i % 6
        text = lambda n=7: "".join(p() if r.random() < 0.8 else p(8, "h3") if r.random() < 0.5 else "<ul>" + p(12, "li") + p(12, "li") + "</ul>" for _ in range(int(r.integers(1, n))))  # noqa: E731, B023
        foot = f'<div id="footer"><p>{say(9)}</p><a href="/p">{say(2)}</a></div>'
        if kind == 0:
            page = f'<div class="site-header"><a href="/">{say(2)}</a></div><div id="menu">{nav}</div><div class="post-body">{p(9, "h1")}{text()}</div><div class="sidebar widget">{nav}</div>{foot}'
        elif kind == 1:
            page = f'<header><nav>{nav}</nav></header><main><article>{p(9, "h1")}{text(12)}</article><section class="comments"><h4>{say(2)}</h4><div class="comment"><p>{say(40)}</p></div></section></main><footer>{say(8)}</footer>'
        elif kind == 2:
            page = f'{p(9, "h1")}{text()}<footer><p>{say(12)}</p></footer>'
        elif kind == 3:
            page = f'<div class="container"><div class="entry-content">{text(5)}</div><div class="ad">{say(14)}</div><form><p>{say(5)}</p><input><button>{say(1)}</button></form></div><div class="cookie-notice">{say(20)}<button>{say(1)}</button></div>'
        elif kind == 4:
            page = text(4)
        else:
            t = say(50)
            want.extend(t.split())
            page = f"<nav>{nav}</nav>{t}"
        out.append((f"<!doctype html><html><head><title>{say(5)}</title><style>p{{}}</style></head><body>{page}<script>var a = '<p>no</p>'</script></body></html>", want))
    return out


def test_html_on_pages_of_another_design():
    model = html_text.default_model()
    hit = found = wanted = 0
    for source, want in other_pages(300):
        got = html_text.extract(source, model).split()
        hit, found, wanted = hit + len(set(got) & set(want)), found + len(got), wanted + len(want)
        assert got or not want, source
    assert 2 * hit / (found + wanted) >= 0.95, (hit, found, wanted)


def test_html_without_wrappers():
    model = html_text.default_model()
    cases = {"<html><body><p>Hello world, this is a page.</p></body></html>": "Hello world, this is a page.", "<div><p>Short.</p></div>": "Short.", "<body>Only bare &amp; short</body>": "Only bare & short", "<b>in</b> <i>line</i>": "in line", "plain text": "plain text", "<ul><li>one</li><li>two</li></ul>": "one two", "<nav><ul><li><a href=1>a</a></li></ul></nav>": "", "<article>a <math><mi>x</mi></math> <object>b<p>c</p></article>": "a x b c", "<p>a<script>x<p>b": "a b"}
    for source, want in cases.items():
        assert html_text.extract(source, model) == want, source


def test_an_index_is_its_folder(spark, docs, none):
    index = substring_dedup.SubstringIndex(spark, buckets=4, window=7)
    index.add(docs.where("doc_id <= 3"))
    index.add(none)
    again = substring_dedup.SubstringIndex(spark, index.path)
    assert (again.buckets, again.window, len(again.stored())) == (4, 7, 2)
    again.compact()
    assert len(index.stored()) == 1
    late = spark.createDataFrame([(50, ROWS[0][1] + " more"), (51, "nothing of the kind")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(late, index=again, window=7).collect()} == {50: 13, 51: 0}


def test_added_columns_replace_clashing_ones(spark, docs, none):
    """Every operator's own column names, given as input columns of another kind; a very long URL."""
    taken = lambda df, names: df.select(*[c for c in df.columns if c not in names], *[F.lit("own").alias(n) for n in names])
    rows = taken(docs, ["ids", "decoded", "n_tokens", "held_out", "lang_pred", "score", "base", "spans"])
    assert bpe.bpe(rows, bpe.default_path()).where("decoded = 'own'").count() == 0
    assert lang_id.identify(rows).where("lang_pred = 'own'").count() == 0 and lang_id.identify(rows).columns.count("held_out") == 1
    assert pii.find_pii(rows).where("size(spans) > 0").count() >= 1
    turns = spark.createDataFrame([(1, 0, "user", "a", "own", "own")], "conv_id long, turn long, role string, text string, formatted string, loss_start string")
    assert chat.format_turns(turns).first()["formatted"] == "<|im_start|>user\na<|im_end|>\n"
    urls = spark.createDataFrame([(1, "http://x.net/" + "a1/" * 200000, "own", "own"), (2, None, "own", "own")], "page_id long, url string, host string, url_score string")
    got = {r["page_id"]: (r["host"], len(r["path"]), r["verdict"]) for r in url_filter.filter_urls(urls).collect()}
    assert got == {1: ("x.net", 600001, "allow"), 2: ("", 0, "allow")}
