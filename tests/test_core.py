"""Trees, parsers, queries, scores, search and upkeep on small fixtures."""

import io
import json
import random
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from sylvan import cli
from sylvan.config import COMPAT, Config
from sylvan.functions import text as X
from sylvan.operators import evaluate, index, order, score, search, tree, walk
from sylvan.operators.lineage import cut
from sylvan.plans import query as Q
from sylvan.sources import discovery, parsers
from sylvan.streaming import watch

MD = "---\nkey: v\n---\nbefore\n# Guide\nintro\n## Setup\npip\n```\n# not a heading\n```\n### Linux\napt\n### Mac\nbrew\n## Usage\nrun it"


def flat_of(df):
    return [(r.ord, r.level, r.title) for r in df.orderBy("doc_id", "ord").collect()]


@pytest.fixture(scope="module")
def md(spark):
    return spark.createDataFrame([("guide", MD), ("plain", "no headings"), ("none", None)], "doc_id string, text string")


def test_markdown(md):
    nodes = parsers.markdown(md)
    assert flat_of(nodes) == [(1, 1, "Guide"), (2, 2, "Setup"), (3, 3, "Linux"), (4, 3, "Mac"), (5, 2, "Usage")]
    assert nodes.where("title = 'Setup'").first().text.startswith("## Setup\npip\n```")
    assert [(r.line_start, r.line_end) for r in nodes.orderBy("ord").collect()][0] == (5, 6)
    assert parsers.markdown(md, drop_preamble=False).count() == 7


def test_plain_text_headings(spark):
    lines = ["1.2 Part two", "0.1 + 0.2 = 0.3", "IV. Four", "B) Letter", "(3) third", "第一章 开始", "三、 数", "SHOUTED TITLE", "", "Under", "=====", "text", "```", "1.1 Not this", "```", "IIII. no"]
    docs = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, text string")
    got = {r.title: r.level for r in parsers.text_headings(docs).where("level is not null").collect()}
    assert got == {"1.2 Part two": 2, "IV. Four": 1, "B) Letter": 2, "(3) third": 2, "第一章 开始": 1, "三、 数": 1, "SHOUTED TITLE": 1, "Under": 1}


def test_parents_are_the_stack(spark):
    r = random.Random(1)
    rows, want = [], {}
    for d in range(30):
        levels = [r.randint(1, 6) for _ in range(r.randint(1, 40))]
        want |= {(d, i): p for i, p in enumerate(tree.stack_parents(levels), 1)}
        rows += [(d, i, n) for i, n in enumerate(levels, 1)]
    out = tree.with_parents(spark.createDataFrame(rows, "doc_id int, ord int, level int")).collect()
    assert {(x.doc_id, x.ord): x.parent_ord or 0 for x in out} == want
    at = {(x.doc_id, x.ord): x for x in out}
    assert all(x.depth == len(x.path) - 1 and x.path[-1] == x.ord and (not x.parent_ord or at[x.doc_id, x.parent_ord].path == x.path[:-1]) for x in out)


def test_ids_hold_still(spark, md):
    nodes = tree.build(parsers.markdown(md))
    ids = {r.title: r.node_id for r in nodes.collect()}
    assert len(set(ids.values())) == 5 and all(re.fullmatch("[0-9a-f]{16}", x) for x in ids.values())
    edited = md.withColumn("text", F.replace("text", F.lit("brew"), F.lit("port")))
    assert {r.title: r.node_id for r in tree.build(parsers.markdown(edited)).collect()} == ids
    twice = tree.build(spark.createDataFrame([("d", i, 1, "Same", "", 1, 1) for i in (1, 2, 3)], "doc_id string, ord int, level int, title string, text string, line_start int, line_end int"))
    assert twice.select("node_id").distinct().count() == 3


def test_traversal(md):
    nodes = tree.build(parsers.markdown(md))
    assert {r.title for r in tree.leaves(nodes).collect()} == {"Linux", "Mac", "Usage"}
    assert {r.ord for r in tree.subtree(nodes, nodes.where("title = 'Setup'")).collect()} == {2, 3, 4}
    assert {r.titles for r in tree.ancestors(nodes).where("ord = 3").collect()} == {"Guide > Setup"}
    assert tree.meaningful_depth(nodes).first().deep and tree.children(nodes, nodes.where("ord = 2")).count() == 2
    assert tree.description(nodes).first().description.startswith("Guide > Setup > Linux > Mac > Usage")


def test_split_and_thin(spark):
    flat = spark.createDataFrame([("d", 1, 1, "A", "x" * 30 + "\n\n" + "y" * 30, 1, 3), ("d", 2, 2, "B", "short", 4, 4), ("d", 3, 1, "C", "z" * 90, 5, 5)], "doc_id string, ord int, level int, title string, text string, line_start int, line_end int")
    got = tree.split_oversized(flat, 40).orderBy("ord").collect()
    assert [(r.level, r.title) for r in got] == [(1, "A"), (2, "A (part 1)"), (2, "A (part 2)"), (3, "B"), (1, "C"), (2, "C (part 1)"), (2, "C (part 2)"), (2, "C (part 3)")]
    assert [(r.title, r.line_end) for r in tree.thinned(flat, 80).orderBy("ord").collect()] == [("A", 4), ("C", 5)]


def test_file_formats():
    assert parsers.json_flat('{"a": {"b": [1, null]}, "c": true}', "d") == [(1, "a", "", 1, 1), (2, "a.b", "", 1, 1), (3, "a.b[0]", "1", 1, 1), (3, "a.b[1]", "None", 1, 1), (1, "c", "c: True", 1, 1)]
    assert [n[:3] for n in parsers.jsonl_flat('{"t": "x", "n": 1}\nbroken\n[2]', "d")] == [(1, "t: x", "t: x\nn: 1"), (1, "record[1]", "[2]")]
    assert parsers.csv_flat("a,b\n1,\n,", "d") == [(1, "d", "Columns: a, b", 1, 1), (2, "a: 1", "a: 1", 2, 2), (2, "Row 3", "", 3, 3)]
    assert [n[:2] for n in parsers.html_flat("<h1>One</h1><p>x</p><script>no</script><h2>Two</h2>y", "d")] == [(1, "One"), (2, "Two")]
    assert [n[:2] for n in parsers.python_flat("class A(B):\n    async def f(self, x: int = 1) -> str: ...\n", "d")] == [(1, "class A(B)"), (2, "async def f(self, x: int=1) -> str")]
    assert parsers.python_flat("def (", "d") == [] and parsers.config_flat("a = 1\n[b]\nc = 2", "d.toml")[1][:2] == (1, "b")
    assert parsers.pdf_headings("2.\nTITLE HERE\nx").startswith("2. TITLE HERE")


def test_pages_of_print(spark):
    assert parsers.pdf_headings("x\nPB-C\nRETINA\nABSTRACT\ny") == "x\nPB-C\nRETINA\n\nABSTRACT\n\ny"
    body = "\n[PAGE 1]\n" + "some words here. " * 40 + "\n[PAGE 2]\n" + "more words there. " * 40
    docs = spark.createDataFrame([("few", body), ("many", parsers.pdf_headings("\n[PAGE 1]\n1.\nFIRST PART\nlow\n2.\nSECOND PART\nhigh")), ("short", "[PAGE 1]\nonly this"), ("none", None)], "doc_id string, text string")
    got = {}
    for r in parsers.paged_text(docs, 500).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.level, r.title))
    assert got == {"few": [(1, "Page 1"), (1, "Page 2")], "many": [(1, "1. FIRST PART"), (1, "2. SECOND PART")], "short": [(1, "short")], "none": [(1, "none")]}


def test_html_with_and_without_headings(spark):
    docs = spark.createDataFrame([("a.html", "<h1>One</h1><p>x</p><h2>Two</h2>y", "a"), ("b.html", "<p>1. First thing</p><p>text</p><p>2. Second thing</p>", "b"), ("c.html", "<p>plain</p>", "c"), ("d.html", "", "d"), ("e.html", None, "e")], "doc_id string, text string, doc_name string")
    got = {}
    for r in parsers.Registry().parse(docs, ".html").orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.title)
    assert got == {"a.html": ["One", "Two"], "b.html": ["1. First thing", "2. Second thing"], "c.html": ["c"], "d.html": ["d"]}


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


def test_office_formats():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>'
    assert parsers.docx_flat(zipped({"word/document.xml": doc}), "d") == [(1, "Top", "Top\nbody", 1, 2)]
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = {"xl/workbook.xml": f'<workbook xmlns="{s}"><sheets><sheet name="S"/><sheet name="E"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c t="inlineStr"><is><t>h</t></is></c></row><row><c><v>1</v></c></row></sheetData></worksheet>', "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{s}"><sheetData/></worksheet>'}
    assert [(n[1], n[2]) for n in parsers.excel_flat(zipped(book), "d")] == [("S (1 rows)", "h\n1"), ("E (0 rows)", "(empty sheet)")]


def test_code_and_registry(spark):
    docs = spark.createDataFrame([("a.go", "package x\ntype T struct {\n}\nfunc (t T) Run() {\n}")], "doc_id string, text string")
    r = parsers.Registry()
    assert flat_of(r.parse(docs, ".go")) == [(1, 1, "type T struct"), (2, 2, "func (t T) Run()")]
    r.register(".up", lambda text, name: [(1, text.upper(), text, 1, 1)])
    assert flat_of(r.parse(docs.select("doc_id", F.lit("abc").alias("text")), ".up")) == [(1, 1, "ABC")]
    assert flat_of(r.parse(docs, ".nothing"))[0][2] == "a.go"


# Queries


def test_modes_and_expressions():
    assert Q.classify("auth*").kind == "prefix" and Q.classify("*auth*").regex == "auth" and Q.classify("au*th").kind == "plain"
    assert Q.classify("user-login").expression.terms == ("userlogin",) and Q.classify("user_login").expression.terms == ("user", "login")
    for bad in ("(", "a AND", "a NEAR/5 b", "nope : a", ""):
        with pytest.raises(ValueError):
            Q.parse(bad)
    with pytest.raises(ValueError):
        Q.classify("(", regex=True)
    assert Q.build_expression(["a", "b c"], "AND", "title") == 'title : (a AND "b c")' and Q.build_expression(["a", "b"], near_distance=3) == "NEAR(a b, 3)"
    plan = Q.query_plan('how does the "login flow" function work in chapter 2')
    assert plan.phrases == ["login flow"] and plan.terms == ["function", "work", "chapter"] and plan.is_code and plan.is_structural
    assert Q.query_plan("the of").terms == ["the", "of"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    words = ["auth", "token", "user", "login", "cache", "error", "Café", "naïve", "index", "the"]
    rows = [(f"d{i // 6}", i % 6 + 1, 1 if i % 6 == 0 else 2, " ".join(r.choices(words, k=2)), " ".join(r.choices(words, k=r.randint(0, 30))), i, i) for i in range(120)]
    nodes = tree.build(spark.createDataFrame(rows, "doc_id string, ord int, level int, title string, text string, line_start int, line_end int")).cache()
    docs = nodes.select("doc_id").distinct().withColumns({"doc_name": F.col("doc_id"), "source_type": F.lit("markdown")})
    found = search.Corpus.of(nodes, docs)
    return search.Corpus(nodes, docs, cut(found.postings), cut(found.stats))


@pytest.mark.parametrize("expression", ["auth", "auth AND token", "auth token", "auth OR cache", "auth NOT token", '"auth token"', "cach*", "NEAR(auth token, 2)", "title : auth", "title : (auth OR user) NOT body : cache", '"user login" OR cafe'])
def test_bm25_is_a_full_text_engine_s(corpus, expression):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(k unindexed, title, summary, body, code_blocks, front_matter, tokenize='unicode61 remove_diacritics 2')")
    for r in corpus.nodes.collect():
        db.execute("insert into f values (?,?,?,?,'','')", (f"{r.doc_id}/{r.node_id}", r.title, r.summary, r.text))
    want = dict(db.execute("select k, -bm25(f, 1, 10, 1, 2, 1, 1) from f where f match ?", (expression,)).fetchall())
    got = {f"{r.doc_id}/{r.node_id}": r.score for r in score.bm25(corpus.postings, corpus.stats, Q.parse(expression), COMPAT).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_wildcard_matrix(spark):
    nodes = spark.createDataFrame([(d, "n", None, 1, 0, [1], t, t, t, 1, 1) for d, t in (("exact", "auth"), ("prefix", "Authentication authorizer"), ("contains", "OAuth"))], "doc_id string, node_id string, parent_node_id string, ord int, depth int, path array<int>, title string, text string, summary string, line_start int, line_end int")
    docs = nodes.select("doc_id", F.col("doc_id").alias("doc_name"), F.lit("text").alias("source_type"))
    c = search.Corpus.of(nodes, docs)
    for query, regex, want in (("auth", False, {"exact"}), ("auth*", False, {"exact", "prefix"}), ("*auth*", False, {"exact", "prefix", "contains"}), ("o?auth", True, {"exact", "prefix", "contains"}), ("zzz", False, set())):
        assert {r.doc_id for r in search.search(c, query, regex=regex).flat_nodes.collect()} == want


def test_batch_is_each_alone(spark, corpus):
    asked = [("q1", "auth token"), ("q2", "naive cache"), ("q3", "nothinghere")]
    config = Config(search_mode="flat", merge_strategy="per_doc")
    got = search.batch_search(corpus, spark.createDataFrame(asked, "query_id string, query string"), config).collect()
    for q, text in asked:
        alone = [(r.doc_id, r.node_id, r.score) for r in search.search(corpus, text, config).flat_nodes.collect()]
        assert [(r.doc_id, r.node_id, r.score) for r in sorted((x for x in got if x.query_id == q), key=lambda x: (x.doc_rank, x.node_rank))] == alone


def test_tree_mode(corpus):
    result = search.search(corpus, "auth token", include_ancestors=True)
    flat, paths = result.flat_nodes.collect(), result.paths.collect()
    assert result.mode == "tree" and flat and len(paths) <= 3 and all(0 <= p.score <= 1 and p.path[-1].node_id == p.target_node_id for p in paths)
    assert sum(len(r.text) for r in flat) <= 32_000 and {r.doc_id for r in result.documents.collect()} == {r.doc_id for r in flat}


def test_walk_limits(corpus):
    plan = Q.query_plan("auth token")
    scores = score.normalised(score.bm25(corpus.postings, corpus.stats, Q.plain("auth token")))
    trees = walk.scored_tree(corpus.nodes, scores)
    found = walk.anchors(trees, plan, 2)
    states = walk.walk(trees, found, plan, Config(max_hops=1, max_expansions=3)).collect()
    assert states and max(s.hop for s in states) <= 1 and max(s.step for s in states) <= 3
    assert max(r.n for r in found.groupBy("doc_id").agg(F.count("*").alias("n")).collect()) <= 2


def test_budget(spark):
    rows = spark.createDataFrame([(1, "a" * 10), (2, "b" * 100), (3, "c" * 100), (4, None)], "rank int, text string")
    assert [len(r.text) for r in search.budgeted(rows, 100).orderBy("rank").collect()] == [10, 30, 30, 0]


def test_budget_of_large_groups(spark):
    """Groups with more texts than characters, unevenly long, empty ones between, places with gaps."""
    r = random.Random(5)
    rows = [(by, 3 * i + 1, r.choice([0, 1, 1, 2, 5, 400])) for by, n in (("a", 900), ("b", 4), (None, 60)) for i in range(n)]
    want = {}
    for by in ("a", "b", None):
        own, left = [x for x in rows if x[0] == by], 500
        for i, (_, rank, n) in enumerate(own):
            got = min(max(left // (len(own) - i), 1) if left > 0 else 0, n)
            want[by, rank], left = got, left - got
    df = spark.createDataFrame([(by, rank, "x" * n) for by, rank, n in rows], "by string, rank int, text string").repartition(5)
    assert {(x.by, x.rank): len(x.text) for x in search.budgeted(df, 500, "by").collect()} == want
    # a text's share is found without a step of the size of all the shares before it
    many = spark.range(40_000).select(F.lit("x").alias("by"), F.col("id").alias("rank"), F.lit("ab").alias("text"))
    assert "aggregate(" not in search.budgeted(many, 50, "by")._jdf.queryExecution().analyzed().toString()
    assert search.budgeted(many, 50, "by").agg(F.sum(F.length("text"))).first()[0] == 50


def test_numbers_over_all_tasks(spark):
    r = random.Random(6)
    rows = [(by, k) for by, n in (("a", 5000), ("b", 1), (None, 300)) for k in range(n)]
    r.shuffle(rows)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small tables would be one task
    try:
        got = order.numbered(spark.createDataFrame(rows, "by string, k int").repartition(7), ["by"], ["k"])
        assert {(x.by, x.k): x.ord for x in got.collect()} == {(by, k): k + 1 for by, k in rows}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_parents_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(tree, "STRETCH", 7)
    r = random.Random(3)
    docs = {d: [r.choice([1, 2, 3, 3, 4, 4, 5, 5, 5]) for _ in range(n)] for d, n in (("a", 90), ("b", 3), ("c", 14))}
    docs["d"] = [1, 2] + [3] * 40
    rows = [(d, i, n) for d, levels in docs.items() for i, n in enumerate(levels, 1)]
    out = tree.with_parents(spark.createDataFrame(rows, "doc_id string, ord int, level int").repartition(3))
    assert "__stretch" in out._jdf.queryExecution().analyzed().toString()  # no window holds a whole document
    assert "__stretch" not in out.columns
    out = out.collect()
    assert {(x.doc_id, x.ord): x.parent_ord or 0 for x in out} == {(d, i): p for d, levels in docs.items() for i, p in enumerate(tree.stack_parents(levels), 1)}
    at = {(x.doc_id, x.ord): x for x in out}
    assert all(x.depth == len(x.path) - 1 and (not x.parent_ord or at[x.doc_id, x.parent_ord].path == x.path[:-1]) for x in out)


def test_texts_join_trees_last(spark):
    """Windows and ids of a tree go by titles; no text is in their way, and none is lost."""
    turns = spark.createDataFrame([("x", i, "user", f"text {i}") for i in range(5)] + [("y", 0, "user", None)], "conv_id string, turn int, role string, text string")
    flat = parsers.conversations(turns)
    with_text = [w for w in tree.build(flat)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in w and "__title" in w and "text" in w]
    assert not with_text
    got = {(r.doc_id, r.ord): r.text for r in tree.build(flat).collect()}
    assert got == {("conv-x", 1): "", ("conv-y", 1): "", ("conv-y", 2): ""} | {("conv-x", i + 2): f"text {i}" for i in range(5)}


@pytest.mark.parametrize("most", [1, 60, 10**6])
def test_best_documents_by_blocks(spark, monkeypatch, most):
    """The best documents of many queries as from all scores: many nodes a document, equal documents, blocks of any size."""
    monkeypatch.setattr(score, "BLOCK_SCORES", most)
    r = random.Random(9)
    words = "alpha beta gamma delta eps zeta eta".split()
    nodes = [(f"d{d:03}", f"n{n}", "", " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for d in range(60) for n in range(r.randint(1, 5))]
    nodes += [("e" + d, n, a, x) for d, n, a, x in nodes[:40]]  # equal documents: the first by id
    df = spark.createDataFrame(nodes, "doc_id string, node_id string, title string, text string")
    posts = cut(index.postings(index.fields(df)))
    stats = index.stats_of(posts, df)
    asked = spark.createDataFrame([(i, " ".join(r.sample(words, r.randint(1, 4)))) for i in range(9)] + [(9, "nothing"), (10, None)], "query_id int, query string")
    everything = {}
    for x in score.bm25_batch(posts, stats, asked).collect():
        everything.setdefault(x.query_id, {}).setdefault(x.doc_id, {})[x.node_id] = x.score
    want = {}
    for q, docs in everything.items():
        for n, d in enumerate(sorted(docs, key=lambda d: (-round(max(docs[d].values()), 9), d))[:3], 1):
            want |= {(q, d, i): (n, round(v, 9)) for i, v in docs[d].items()}
    got = score.batch_routed(posts, stats, asked, 3).collect()
    assert {(x.query_id, x.doc_id, x.node_id): (x.doc_rank, round(x.score, 9)) for x in got} == want and len(got) == len(want)


def test_postings_are_sorted_in_small_batches(spark):
    """Words sorted at a time, and rows sent to Python at a time, stay small whatever the tables are."""
    assert index.BATCH_WORDS <= 250_000
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([("a", "1", "", "Über über UBER x_y 语言处理 ŵ")], "doc_id string, node_id string, title string, text string")
    got = {(p.term, p.tf) for p in index.postings(index.fields(df, with_summary=False)).collect()}
    assert got == {("uber", 3), ("x", 1), ("y", 1), ("语言", 1), ("言处", 1), ("处理", 1), ("w", 1)}
    assert 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= 8 << 20


def test_evidence_by_words_and_without(spark):
    """Beginnings with whole words in them are looked up by one; those without are held against every text."""
    texts = ["xx the quick brown fox jumps over the lazy dog and runs", "unquick brown fox", "a QUICK\nbrown  fox jumps", "whole", "unwholesome", "", None, "quick browned"]
    docs = spark.createDataFrame([(i, "n1", x) for i, x in enumerate(texts)], "doc_id int, node_id string, text string")
    asked = [(0, "ick Brown fox"), (1, "quick brown fox jumps over a fence"), (2, "hole"), (3, "no such words at all"), (4, ""), (5, None), (6, "quick bro")]
    evidence = spark.createDataFrame(asked, "query_id int, text string")
    clean = lambda x: " ".join((x or "").lower().split())
    want = set()
    for q, x in asked:
        for n in (20, 12, 5):
            found = {(q, i) for i, d in enumerate(texts) if clean(x)[:n] and clean(x)[:n] in clean(d)}
            if found:
                want |= found
                break
    out = evaluate.evidence_match(evidence, docs, (20, 12, 5))
    assert {(r.query_id, r.doc_id) for r in out.collect()} == want
    long = evaluate.evidence_match(spark.createDataFrame([(1, "quick brown fox jumps")], "query_id int, text string"), docs)
    assert {r.doc_id for r in long.collect()} == {0, 2}


def test_functions(spark):
    one = spark.range(1)
    got = one.select(X.tokens(F.lit("Café user_login-x 12 ß")), X.cjk_tokens(F.lit("全文检索 ab")), X.summary(F.lit("x" * 700)), X.highlight(F.lit("An apple"), ["app"]), X.normal_answer(F.lit("The $5.2 Million!"))).first()
    assert got[0] == ["cafe", "user", "login", "x", "12", "ß"] and got[1] == ["全文", "文检", "检索", "ab"] and len(got[2]) == 355 and got[3] == "An «app»le" and got[4] == "5.2"


def test_scorers(spark, corpus):
    nodes = spark.createDataFrame([("d", "0", 1, 5, "x"), ("d", "1", 2, 3, "x"), ("d", "2", 4, 5, "x")], "doc_id string, node_id string, line_start int, line_end int, text string")
    lines = spark.createDataFrame([("d", i, "hit" if i in (2, 3, 4) else "no") for i in range(1, 6)], "doc_id string, line int, raw string")
    assert {r.node_id: round(r.score, 4) for r in score.grep_lines(lines, nodes, "hit").collect()} == {"0": 1.0, "1": 0.6667, "2": 0.3333}
    raw = score.bm25(corpus.postings, corpus.stats, Q.plain("auth"))
    out = score.propagated(score.normalised(raw), corpus.nodes)
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() >= raw.count()


# Upkeep


def test_folder_lifecycle(spark, tmp_path, capsys):
    folder, store = tmp_path / "docs", index.Index(spark, str(tmp_path / "ix"))
    (folder / "node_modules").mkdir(parents=True)
    (folder / "a.md").write_text(MD)
    (folder / "b.md").write_text("# Other\nwords about caching")
    (folder / "node_modules" / "c.md").write_text("# no")
    (folder / ".gitignore").write_text("skip*.md\n")
    (folder / "skipped.md").write_text("# no")
    assert watch.sync(store, str(folder)) == {"moved": 0, "indexed": 2, "pruned": 0}
    assert watch.sync(store, str(folder)) == {"moved": 0, "indexed": 0, "pruned": 0}
    (folder / "a.md").write_text(MD.replace("brew", "port"))
    (folder / "b.md").rename(folder / "z.md")
    assert watch.sync(store, str(folder)) == {"moved": 1, "indexed": 1, "pruned": 0}
    assert cli.main(["search", str(tmp_path / "ix"), "port", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["title"] == "Mac"
    (folder / "z.md").unlink()
    assert watch.sync(store, str(folder))["pruned"] == 1
    assert not any(store.verify(files=True).values()) and store.stats().first().documents == 1
    store.compact()
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert store.delete(["nothing"]) == 0 and store.indexed_files().count() == 1
    with pytest.raises(ValueError):
        discovery.listing(spark, [str(folder)], max_files=0 or 1, extensions=[".md", ".nope"], respect_ignore=False)


def test_node_diff_touches_one_node(spark, md):
    old = tree.build(parsers.markdown(md))
    new = tree.build(parsers.markdown(md.withColumn("text", F.replace("text", F.lit("brew"), F.lit("port")))))
    states = {r.state: r.n for r in index.node_diff(old, new).groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert states == {"kept": 4, "changed": 1}


def names_of(store):
    return sorted(r.doc_name for r in store.table("documents").collect())


def test_pruning_stays_within_folder_extension_and_disk(spark, tmp_path):
    one, two, store = tmp_path / "one", tmp_path / "two", index.Index(spark, str(tmp_path / "ix"))
    for folder in (one, two):
        folder.mkdir()
    for path in (one / "a.md", one / "b.txt", two / "c.md", two / "d.md"):
        path.write_text(f"# {path.name}\ntext of {path.name}")
    watch.sync(store, str(one))
    assert watch.sync(store, str(two)) == {"moved": 0, "indexed": 2, "pruned": 0} and names_of(store) == ["a", "b", "c", "d"]
    assert watch.sync(store, str(one), [".md"])["pruned"] == 0 and names_of(store) == ["a", "b", "c", "d"]
    (two / ".gitignore").write_text("d.md\n")
    assert watch.sync(store, str(two))["pruned"] == 0 and names_of(store) == ["a", "b", "c", "d"]
    (one / "a.md").unlink()
    (one / "b.txt").unlink()
    assert watch.sync(store, str(one), [".md"])["pruned"] == 1 and names_of(store) == ["b", "c", "d"]
    assert watch.sync(store, str(one), prune=False)["pruned"] == 0 and watch.sync(store, str(two), prune=True)["pruned"] == 2
    assert names_of(store) == ["c"] and not any(store.verify().values())
    with pytest.raises(FileNotFoundError):
        watch.sync(store, str(tmp_path / "unmounted"))
    assert store.delete_paths(str(two / "c.md"), "nothing") == 1 and names_of(store) == []


def test_edits_anywhere_are_seen(spark, tmp_path):
    folder, store = tmp_path / "docs", index.Index(spark, str(tmp_path / "ix"))
    folder.mkdir()
    text = "# A\n" + "words " * 3000
    (folder / "a.md").write_text(text)
    assert watch.sync(store, str(folder))["indexed"] == 1
    (folder / "a.md").write_text(text[:7000] + "WORDS " + text[7006:])
    assert watch.sync(store, str(folder))["indexed"] == 1 and watch.sync(store, str(folder))["indexed"] == 0
    assert watch.sync(store, str(folder), force=True)["indexed"] == 1
    nodes = store.table("nodes").collect()
    assert max(len(r.text) for r in nodes) <= 8000 and {r.title for r in nodes} == {"A", "A (part 1)", "A (part 2)", "A (part 3)"}
    with pytest.raises(ValueError):
        (folder / "b.md").write_text("# B")
        watch.sync(store, str(folder), max_files=1)
    assert watch.sync(store, str(folder), max_files=0)["indexed"] == 1


def test_segments_merge_and_missing_files_go(spark, tmp_path):
    folder, store = tmp_path / "docs", index.Index(spark, str(tmp_path / "ix"))
    folder.mkdir()
    store.MAX_SEGMENTS = 2
    for i in range(3):
        (folder / "a.md").write_text(f"# A\nedition{i} text")
        (folder / f"m{i}.md").write_text(f"# M\nfile{i}")
        assert watch.sync(store, str(folder))["indexed"] == 2
    assert len(store.segments()) <= 2 and names_of(store) == ["a", "m0", "m1", "m2"]
    found = search.search(search.Corpus.saved(store), "edition2 edition1", Config(search_mode="flat")).flat_nodes.collect()
    assert [r.text for r in found] == ["# A\nedition2 text"]
    (folder / "m1.md").unlink()
    assert store.verify(files=True)["missing_files"] == 1 and store.repair(drop_missing_files=True)["missing_files"] == 1
    assert names_of(store) == ["a", "m0", "m2"] and not any(store.verify(files=True).values())
    assert store.is_indexed(store.table("documents").first().doc_id) and not store.is_indexed("no")


def test_ignore_rules(spark):
    rules = ["*.log", "!keep.log", "/top.md", "build/", "a/**/z.md", "x[0-9].md", "[!a]b.txt", "# note", "doc?.md", "sp ace.md "]
    paths = {"a.log": True, "d/keep.log": False, "top.md": True, "d/top.md": False, "d/build/x.md": True, "build": False, "a/z.md": True, "a/b/c/z.md": True, "x1.md": True, "xy.md": False, "cb.txt": True, "ab.txt": False, "doc1.md": True, "doc12.md": False, "sp ace.md": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.hit for r in df.select("path", discovery.is_ignored(F.col("path"), rules).alias("hit")).collect()} == paths
    with pytest.warns(UserWarning, match="no such path"):
        assert discovery.listing(spark, ["/no/such/folder"]).count() == 0


def test_chinese(spark, tmp_path):
    folder, store = tmp_path / "docs", index.Index(spark, str(tmp_path / "ix"))
    folder.mkdir()
    (folder / "cn.md").write_text("# 项目简介\n本项目旨在构建一个高效的语义检索系统，支持中文和英文混合搜索。\n# 技术方案\n核心技术包括：SQLite 全文检索、BM25排序算法。机器学习是人工智能的分支")
    (folder / "en.md").write_text("# English\nplain words only")
    assert watch.sync(store, str(folder))["indexed"] == 2
    corpus = search.Corpus.saved(store)
    titles = lambda q, **o: [r.title for r in search.search(corpus, q, Config(search_mode="flat"), **o).flat_nodes.collect()]
    assert titles("机器学习") == ["技术方案"] and titles("语义检索") == ["项目简介", "技术方案"] and titles("全文 words") and titles("量子") == []
    assert titles("x", expression='"语义检索"') == ["项目简介"] and titles("x", expression="全文检索 AND BM25") == ["技术方案"]
    words = search.Corpus.of(corpus.nodes.drop("body", "code_blocks", "front_matter"), corpus.documents, mode="word", dictionary=("机器学习", "检索系统"))
    assert {r.col for r in words.postings.where("term = '机器学习'").collect()} == {"body", "summary"} and [r.title for r in search.search(words, "机器学习").flat_nodes.collect()] == ["技术方案"]
    assert Q.words("用BM25排序", "char") == ["用", "bm25", "排", "序"] and Q.words("机器学习吗", "word", ("机器学习",)) == ["机器学习", "吗"]


def test_deep_trees(spark):
    levels = [*range(1, 10), 5, 9, 2]
    flat = spark.createDataFrame([("d", i, n, f"t{i}", "", i, i) for i, n in enumerate(levels, 1)], "doc_id string, ord int, level int, title string, text string, line_start int, line_end int")
    got = {r.ord: r for r in tree.build(flat).collect()}
    assert [got[i].parent_ord or 0 for i in range(1, len(levels) + 1)] == tree.stack_parents(levels) and got[9].path == list(range(1, 10))
    shaped = tree.shaped(flat.withColumn("text", F.lit("ab")), split=None, thin=1000)
    assert [r.text for r in shaped.collect()] == ["\n\n".join(["ab"] * 12)]


def test_node_and_document_calls(corpus):
    got = search.search_nodes(corpus, "auth token", 10).collect()
    raw = {(r.doc_id, r.node_id): r.score for r in score.bm25(corpus.postings, corpus.stats, Q.plain("auth token")).collect()}
    said = {(r.doc_id, r.node_id) for r in score.bm25(corpus.postings, corpus.stats, Q.parse('"auth token"')).collect()}
    best = sorted(raw, key=lambda k: (-round(raw[k], 9), k))[:10]
    want = {k: round(raw[k] * (1.5 if k in said else 1), 6) for k in best}
    assert {(r.doc_id, r.node_id): r.score for r in got} == pytest.approx(want) and len(set(want) & said) > 0
    docs = search.search_documents(corpus, "auth token", 5).collect()
    assert len(docs) == 5 and docs[0].best_score == max(d.best_score for d in docs) and all(d.doc_name == d.doc_id for d in docs)
    ids = [(r.doc_id, r.node_id) for r in search.ranked_ids(corpus, "auth token", 4).collect()]
    scores = {(r.doc_id, r.node_id): r.score for r in search.document_scores(corpus, "auth token").collect()}
    assert ids == sorted(scores, key=lambda k: (-scores[k], k))[:4]
    many = search.search_many(corpus, [{"query": "auth"}, {"query": "x", "expression": "cache AND error"}, {"query": "tok.n", "regex": True}]).collect()
    for i, q in enumerate([{"query": "auth"}, {"query": "x", "expression": "cache AND error"}, {"query": "tok.n", "regex": True}]):
        assert [(r.doc_id, r.node_id, r.score) for r in many if r.query_no == i] == [(r.doc_id, r.node_id, r.score) for r in search.search(corpus, **q).flat_nodes.collect()]
    nothing = search.search(corpus, "zzzz")
    assert nothing.flat_nodes.count() == 0 and [r.doc_id for r in nothing.routed.orderBy("doc_rank").collect()] == ["d0", "d1", "d10"]


def test_public_names_and_commands(spark, tmp_path, capsys):
    import sylvan

    assert all(hasattr(sylvan, n) for n in sylvan.__all__)
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# A\nwords here")
    (folder / "b.txt").write_text("other words")
    assert cli.main(["index", str(tmp_path / "ix"), str(folder), "--max-files", "5"], spark) == 0
    assert json.loads(capsys.readouterr().out)["indexed"] == 2
    assert cli.main([str(tmp_path / "ix"), "words", "--format", "json"], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["delete", str(tmp_path / "ix"), str(folder / "a.md")], spark) == 0 and json.loads(capsys.readouterr().out) == {"deleted": 1}


def test_watch_stream(spark, tmp_path):
    folder, store, seen = tmp_path / "docs", index.Index(spark, str(tmp_path / "ix")), []
    folder.mkdir()
    (folder / "a.md").write_text("# A\nx")
    q = watch.watch(store, str(folder), checkpoint=str(tmp_path / "cp"), trigger={"availableNow": True}, after=seen.append)
    q.awaitTermination(60)
    assert seen and store.table("documents").count() == 1


def test_watch_sees_edits_and_deletions(spark, tmp_path):
    import time

    folder, store, seen = tmp_path / "docs", index.Index(spark, str(tmp_path / "ix")), []
    folder.mkdir()
    for name in ("a.md", "b.txt", "c.md"):
        (folder / name).write_text(f"# T\n{name}")
    q = watch.watch(store, str(folder), checkpoint=str(tmp_path / "cp"), after=seen.append)

    def until(ready):
        end = time.time() + 90
        while time.time() < end and not ready():
            time.sleep(0.3)
        assert ready()

    try:
        assert names_of(store) == ["a", "b", "c"]
        (folder / "a.md").write_text("# T\nA.md")
        until(lambda: any(d["indexed"] == 1 for d in seen))
        (folder / "c.md").unlink()
        until(lambda: any(d["pruned"] == 1 for d in seen))
        assert names_of(store) == ["a", "b"]
    finally:
        q.stop()


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, item string, rank int")
    m = evaluate.ranking_metrics(ranked, spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "a")], "query_id string, item string"), 2).collect()
    by = {r.query_id: r for r in m}
    assert (by["q"].precision, by["q"].recall, by["q"].hit, by["q"].rr) == (0.5, 0.5, 1.0, 0.5) and by["r"].rr == 0.0
    a = evaluate.answer_metrics(spark.createDataFrame([("q", "The cat sat", "a cat ran"), ("r", None, "x")], "query_id string, answer string, gold string")).collect()
    assert {r.query_id: r.f1 for r in a} == {"q": pytest.approx(0.5), "r": 0.0}
    chunks = evaluate.paragraph_chunks(spark.createDataFrame([("d", "aa\n\nbb\n\n" + "c" * 9)], "doc_id string, text string"), 8).collect()
    assert [c.text for c in chunks] == ["aa\n\nbb", "c" * 9]
