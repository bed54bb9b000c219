"""PII terms over the whole corpus, and null keys in the near-duplicate stage."""

from compare import DATA
from pyspark.sql import functions as F

from pagewright.llm import jaccard_join, pii


def test_disclosing_terms_are_marked_everywhere(spark):
    far = " ".join(f"w{k}" for k in range(30))
    rows = [(i, f"u{i} jane smithson {far} jane@corp.com and smithson again v{i}") for i in range(4)]
    rows += [(10 + i, f"note {i} {far} x+smithson1 about Smithson") for i in range(1)] + [(None, "smithson alone"), (20, None)]
    rows += [(30 + i, f"note {far} common {i}") for i in range(400)]
    rows += [(500 + i, "bob@corp.com copied onlyhere") for i in range(9)]
    rows += [(600 + i, f"text {i} a{i} b{i} -- regards quillon zed@corp.com") for i in range(5)]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["sanitised"] or "" for r in pii.sanitise(found).select("doc_id", "sanitised").collect()}
    assert len(got) == len(rows) and found.count() == len(rows)
    assert not any("smithson" in got[i].lower().replace("smithson1", "") for i in [0, 1, 2, 3, 10, None])
    assert "smithson1" in got[10] and "w3" in got[0] and "onlyhere" in got[500] and "quillon" not in got[600]


def test_words_outside_of_base_spans(spark):
    texts = ["ab4111 1111 1111 1111cd ef", "to a@b.c, x+1 (743) 555-3824y z", "none"]
    df = pii.find_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [set(r["own"] or []) for r in pii.vocabulary(df, "text").select("own").collect()]
    assert got == [{"ef"}, {"to", "x", "z"}, set()] and df.where(F.size("base") > 0).count() == 2


def test_stage_keeps_null_keys(spark):
    text = "the quick brown fox jumps over the lazy dog again and again today"
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (None, text)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in jaccard_join.stage_jaccard(spark, docs, DATA).collect()) == ["1", "None", "None"]


def test_terms_equal_brute_force(spark):
    import math
    from collections import defaultdict

    import regex
    from test_contracts import KINDS, base_spans

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, f"u{i} Jane smithson{i % 2} writes to jane.{i // 3}@corp{i % 2}.org or +1 743 555 {3000 + i // 4}, smithson0x") for i in range(24)]
    rows += [(2 * 10**6 + i, f"a smithson1 and JANE {i % 3}") for i in range(4)] + [(None, "jane smithson0"), (5, None)]
    total, docs = len(rows), []
    for key, text in rows:
        t = text or ""
        spans = [s.split(":") for s in base_spans(t).split(",") if s]
        spans = [(int(a), int(b), k) for k, a, b in spans]
        entities = {f"{k}:{t[a:b].lower()}" for a, b, k in spans} | {f"kind:{k}" for _, _, k in spans} | {"domain:" + t[a:b].lower().rsplit("@", 1)[1] for a, b, k in spans if k == "email"}
        free = [m for m in regex.finditer(r"[\p{L}\p{N}]+", t) if not any(m.start() < b and a < m.end() for a, b, _ in spans)]
        docs.append((key, t, entities, {w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t)}, free, spans))
    n_entity, n_term, both, ways = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for _, t, entities, words, free, _ in docs:
        for w in words:
            n_term[w] += 1
        own = {m[0].lower() for m in free}
        for e in entities:
            n_entity[e] += 1
            for w in own:
                both[e, w] += 1
                ways[e, w].add(t)
    terms = set()
    for (e, w), n in both.items():
        information = math.log2(total / n_entity[e])
        if len(ways[e, w]) >= pii.SUPPORT and information > 0 and math.log2(n * total / (n_term[w] * n_entity[e])) / information >= pii.GENERALISE:
            terms.add(w)
    order = {k: i for i, k in enumerate([*KINDS, "term"])}
    want = sorted((str(key), ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted([(a, order[k], k, b) for a, b, k in spans] + [(m.start(), 4, "term", m.end()) for m in free if m[0].lower() in terms]))) for key, _, _, _, free, spans in docs)
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined(F.col("spans")).alias("s"))
    assert {"smithson0", "smithson1", "writes"} <= terms and sorted((str(r["doc_id"]), r["s"]) for r in found.collect()) == want
