import numpy as np
from pyspark.sql import functions as F

from clausewell.functions import text as X
from clausewell.operators import corpus, evaluate, match, retrieve


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, X.norm(F.lit("a　b c\x1cd"))) == "abcd"
    assert one(spark, X.ngram_coverage(F.lit("abcdabcd"), F.lit("xabcdx"))) == 0.4
    assert one(spark, X.ngram_coverage(F.lit("ab"), F.lit("xaby"))) == 1.0
    assert one(spark, X.ngram_coverage(F.lit(""), F.lit("x"))) == 0.0
    assert [one(spark, X.number(F.lit(s))) for s in ("1,200.5", "5.3%", "(12)", "—", "-7", "１２", "1 2", " 3\u3000")] == [1200.5, None, None, None, -7.0, 12.0, None, 3.0]
    assert one(spark, X.clean_title(F.lit("资本办法（PDF）"))) == "资本办法"
    assert [one(spark, X.cell_address(F.lit(r), F.lit(c))) for r, c in ((5, 3), (2, 27), (1, 26), (1, 702), (1, 703), (9, 16384))] == ["C5", "AA2", "Z1", "ZZ1", "AAA1", "XFD9"]


def folded(units, limit=420, least=120):
    """A plain model of block numbers: units (length, boundary)."""
    size, block, out = 0, -1, []
    for n, cut in units:
        if not out or size > 0 and (cut and size > least or size + n > limit):
            block, size = block + 1, 0
        size += n
        out.append(block)
    return out


def unit_rows(spark, cases):
    units = [(k, [(i, f"para{i}", ("第一条" if cut else "") + "x" * (n - 3 * cut)) for i, (n, cut) in enumerate(case)]) for k, case in enumerate(cases)]
    return spark.createDataFrame(units, "doc_id bigint, units array<struct<unit_no:int,location:string,text:string>>")


def test_fold(spark):
    rng = np.random.default_rng(6)
    cases = [[(100, False), (30, True), (50, True), (300, False)], [], [(500, False)]]
    cases += [[(int(rng.integers(3, 200)), bool(rng.integers(0, 2))) for _ in range(rng.integers(1, 30))] for _ in range(60)]
    got = {}
    for r in corpus.fold(unit_rows(spark, cases), "units").collect():
        got.setdefault(r.doc_id, {})[r.block_no] = r
    for k, case in enumerate(cases):
        want = folded(case)
        assert [got[k][b].n_units for b in sorted(set(want))] == [want.count(b) for b in sorted(set(want))] and len(got.get(k, {})) == len(set(want))
        for b in set(want):
            places = [i for i, x in enumerate(want) if x == b]
            assert got[k][b].location == (f"para{places[0]}" if len(places) == 1 else f"para{places[0]}-para{places[-1]}")
            assert len(got[k][b].text) == sum(case[i][0] for i in places) + len(places) - 1
    assert [b for b in folded(cases[0])] == [0, 0, 1, 1]
    one = corpus.collected(spark.createDataFrame([(1, 1, "b", "y"), (1, 0, "a", "x")], "doc_id int, unit_no int, location string, text string"))
    assert [u.text for u in one.first().units] == ["x", "y"]


def test_headings(spark):
    texts = ["第三条 …", "（二）…", "(二)…", "12.5%…", "附 件 1", "十一、x", "3、x", "x第三条", "第\n三条"]
    assert [one(spark, X.heading(F.lit(s))) for s in texts] == [True, True, False, True, True, True, False, False, False]


def test_text_blocks(spark):
    long_text = "x" * 500 + "。"
    rows = [(i, f"n{i}", kind, [(0, "para0", "短。"), (1, "para1", long_text)]) for i, kind in enumerate(("doc", "pdf", "xls"))]
    docs = spark.createDataFrame(rows, "doc_id int, orig_name string, type string, units array<struct<unit_no:int,location:string,text:string>>")
    got = {r.block_id: r for r in corpus.text_blocks(docs).collect()}
    assert set(got) == {f"{d}-{b}" for d in (0, 1) for b in ("0-0", "1-0", "1-1")}
    assert got["0-1-0"].source_type == "word" and got["1-1-1"].source_type == "pdf" and [len(got[f"0-1-{k}"].text) for k in (0, 1)] == [501, 60]
    assert tuple(corpus.block_counts(docs, corpus.text_blocks(docs), docs.limit(1)).first()) == (2, 6, 1)


def test_secrets(spark):
    texts = ["SK-" + "a1_." * 5, "api-key: 'abcdefgh", 'PASSWD = "12345678', "token='short'", "sk-abc", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = corpus.secret_lines(docs)
    assert {(r.doc_id, r.label) for r in found.collect()} == {(0, "model key"), (1, "api key"), (2, "credential")}
    assert tuple(corpus.secret_verdict(found).first()) == (3, False)
    assert tuple(corpus.secret_verdict(corpus.secret_lines(docs, allowed=docs.where("doc_id < 3"))).first()) == (0, True)


def test_verification(spark):
    mapping = spark.createDataFrame([(k, f"z/data/{k}", f"l{k}", "pdf" if k < 2 else "doc") for k in range(4)], "doc_id int, zip_path string, local_path string, type string")
    manifest = spark.createDataFrame([("0", 5, "a"), ("1", 6, "b"), ("3", 7, "c")], "path string, size int, sha256 string")
    verified = corpus.verify(mapping, manifest, spark.createDataFrame([("l0", "a"), ("l1", "x"), ("l2", "y")], "local_path string, actual string"))
    assert {r.doc_id: r.status for r in verified.collect()} == {0: "ok", 1: "hash_mismatch", 2: "not_in_manifest", 3: "missing"}
    assert {tuple(r) for r in corpus.problems(verified).collect()} == {(1, "hash_mismatch", "l1"), (2, "not_in_manifest", "2"), (3, "missing", "l3")}
    assert {tuple(r) for r in corpus.verify_counts(verified).collect()} == {("all", 4, 1, 3), ("pdf", 2, 1, 1), ("doc", 2, 0, 2)}
    files = spark.createDataFrame([("long/name", "h"), ("b", "h"), ("a", "h"), ("z", "g")], "path string, sha string")
    assert {tuple(r) for r in corpus.exact_copies(files, "path", "sha").collect()} == {("h", "a", 3), ("g", "z", 1)}


def test_tokens(spark):
    assert one(spark, retrieve.tokens(F.lit("资本充足 ratio 12.5%A类"))) == ["资", "本", "充", "足", "资本", "本充", "充足", "ratio", "12", "5", "A", "类"]
    blocks = spark.createDataFrame([(1, "保险公司资本充足率"), (2, "银行存款利率"), (3, None), (4, "公司")], "block_id int, text string")
    asked = spark.createDataFrame([(7, "资本充足")], "query_id int, text string")
    assert [r.block_id for r in retrieve.bm25(blocks, asked).collect()] == [1]
    by_letter = retrieve.bm25(blocks, asked, tokenizer=lambda t: F.split(t, "")).collect()
    assert [r.block_id for r in by_letter] == [1]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, block_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, block_id string, rank int")
    assert [r.block_id for r in retrieve.fuse(a, b).orderBy("rank").collect()] == ["y", "x", "z"]


def test_dense_keeps_the_smallest_ids_of_equal_vectors(spark):
    """Exact best k by rounded score, then block_id, with groups of copies larger than k, whatever the blocks are."""
    rng = np.random.default_rng(2)
    kinds = rng.standard_normal((4, 6))
    rows = [(int(i), kinds[n % 4] / np.linalg.norm(kinds[n % 4])) for n, i in enumerate(rng.permutation(120))]
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "block_id bigint, vector array<double>").repartition(3)
    asked = vectors.where("block_id % 7 = 0").withColumnRenamed("block_id", "query_id")
    want = {}
    for q, u in rows:
        if q % 7 == 0:
            want[q] = [i for _, i in sorted((-round(float(u @ v), 9), i) for i, v in rows)[:5]]
    for batch in (1024, 8):
        got = {q: [] for q in want}
        for r in retrieve.dense(vectors, asked, k=5, batch=batch).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.block_id)
        assert got == want


def test_dense_without_rows(spark):
    none = spark.createDataFrame([], "block_id bigint, vector array<double>")
    assert retrieve.dense(none, none.withColumnRenamed("block_id", "query_id")).count() == 0


def split_model(groups, share=3, slack=15):
    out, total = {}, sum(groups.values())
    quota, running = round(total / share), 0
    for g, n in sorted(groups.items(), key=lambda x: (x[1], x[0])):
        dev = running < quota and running + n <= quota + slack
        running += n * dev
        out[g] = "dev" if dev else "test"
    return out


def test_split_by_a_plain_model(spark):
    rng = np.random.default_rng(3)
    groups = {s: {f"g{i}": int(rng.integers(1, 25)) for i in range(rng.integers(1, 40))} for s in map(str, range(25))}
    sizes = spark.createDataFrame([(s, g, n) for s, own in groups.items() for g, n in own.items()], "stratum string, grp string, n bigint")
    got = {(r.stratum, r.grp): r.split for r in evaluate.group_split(sizes).collect()}
    assert got == {(s, g): x for s, own in groups.items() for g, x in split_model(own).items()}


def test_split(spark):
    sizes = spark.createDataFrame([("s", str(i), n) for i, n in enumerate([1, 1, 2, 3, 5])], "stratum string, grp string, n bigint")
    assert {r.grp for r in evaluate.group_split(sizes).collect() if r.split == "dev"} == {"0", "1", "2"}


def test_numbers(spark):
    missing = lambda a, e: one(spark, evaluate.missing_numbers(F.lit(a), F.lit(e)))
    assert missing("[1] 资本为10.50亿元", "…10.5亿元") == []
    assert missing("1. 共37家", "共36家") == ["37"]


def test_common_substring(spark):
    a = spark.createDataFrame([(1, "abcdefghijklmno")], "a_id int, s string")
    b = spark.createDataFrame([(1, "xxabcdefghijklmnoyy"), (2, "abcdefghijklmn")], "b_id int, s string")
    assert [(r.b_id, r.lcs) for r in match.common_substring(a, b).collect()] == [(1, 15)]


def test_question_parts(spark):
    q = F.lit("《甲办法》工作表：表1（续）），。 “净利润”从“2023年”到“2024年”")
    assert (one(spark, X.question_title(q)), one(spark, X.question_sheet(q)), one(spark, X.question_terms(q))) == ("甲办法", "表1（续）", ["净利润", "2023年", "2024年"])
    assert tuple(one(spark, X.difference_terms(q))) == ("净利润", "2023年", "2024年") and one(spark, X.difference_terms(F.lit("x"))) is None
    e = F.lit("单元格：C5；原始值：-1.5；利润=20.25(D6)；一二三四五六七八")
    assert (one(spark, X.evidence_cells(e)), one(spark, X.evidence_numbers(e)), one(spark, X.statements(e))) == (["C5", "D6"], [-1.5, 20.25], ["原始值：-1.5", "利润=20.25(D6)", "一二三四五六七八"])


def test_question_without_parts(spark):
    q = F.lit("why")
    assert (one(spark, X.question_title(q)), one(spark, X.question_sheet(q)), one(spark, X.question_terms(q))) == (None, None, [])
