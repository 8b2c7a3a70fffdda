"""HTML, urls, search, embeddings and archives on small fixtures, against brute force or SQL."""

import gzip
import io
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sylvan.llm import embed_dedup, html_template, topk, url_reputation, warc

from .conftest import prose, rows_of

PAGES = "page_id long, url string, html string"


def page(i: int, host: str, body: str) -> tuple:
    return (i, f"https://{host}/en/{i}", f"<html><head><title>T{i}</title></head><body><nav><ul><li>Home of {host}<li>About us all</ul></nav><p>{body}</p><footer>All rights of {host}</footer></body></html>")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [page(i, "a.example.com", prose(i, 12)) for i in range(6)] + [page(10 + i, "b.co.uk", prose(50 + i, 12)) for i in range(2)]
    rows += [(20, None, "<p>no host here at all</p>"), (21, "https://a.example.com/x", None), (22, "https://a.example.com/y", ""), (None, "not a url", "<div><p>open <b>tags"), rows[0], rows[0]]
    rows += [(23, "https://c.example.org/1", "<p>" + "long words " * 100_000 + "</p>"), (24, "https://c.example.org/2", rows[1][2]), (25, "https://c.example.org/3", rows[1][2])]
    return spark.createDataFrame(rows, PAGES)


class TestHtml:
    def test_templates_go_and_texts_stay(self, pages):
        got = {r.page_id: r for r in html_template.extracted(pages).collect()}
        assert got[3].text == f"T3\n{prose(3, 12)}" and got[3].deleted == 2
        assert "Home of b.co.uk" in got[11].text and got[11].deleted == 0
        assert got[20].text == "no host here at all" and got[None].text == "open tags"
        assert got[21].text is None and got[22].text == ""
        assert len(got[23].text) == len("long words " * 100_000) - 1

    def test_both_joins_agree(self, pages, monkeypatch):
        first = rows_of(html_template.extracted(pages))
        monkeypatch.setattr(html_template, "BROADCAST_ROWS", -1)
        assert rows_of(html_template.extracted(pages)) == first

    def test_counts_are_brute_force(self, pages):
        seen, sizes = defaultdict(Counter), Counter()
        for r in pages.collect():
            host = r.url.split("/")[2].lower() if r.url and "://" in r.url else ""
            if host:
                sizes[host] += 1
                seen[host].update(html_template.candidates(html_template.parse(r.html)[1]) if r.html else [])
        want = {h: sorted(k for k, n in c.items() if n >= 3 and n >= 0.005 * sizes[h]) for h, c in seen.items()}
        assert {r.host: r.templates for r in html_template.templates(pages).collect()} == {h: x for h, x in want.items() if x}

    def test_markup(self):
        text = lambda s: html_template.text_of(html_template.parse(s)[0], set())[0]
        assert text("<p>a<p>b<br>c<ul><li>x<li>y</ul>d") == "a\nb\nc\nx\ny\nd"
        assert text('<script>"</p>"</script>x &amp; y<!-- z -->') == "x & y"
        assert text("<table><tr><td>1<td>2</table></b></nope><") == "1\n2\n<"
        assert text("") == "" and text("<") == "<" and text("<style>a") == ""
        assert text("<div>" * 3000 + "deep") == "deep"

    def test_long_broken_markup_takes_time_in_proportion(self):
        import time

        mega = 1_000_000
        for text in ("<a" * (mega // 2), "<div>" * 100_000 + "</x>" * 100_000, "<b>" * 100_000 + "<li></li>" * 50_000, "<a \"" * (mega // 4) + ">", "<a '\"" * (mega // 5), "<!" * (mega // 2), "<i>" * 50_000 + "<p>x" * 50_000, "<a \"x'" * 50_000 + "<p>" * 50_000, "<" * mega):
            begin = time.process_time()
            html_template.text_of(html_template.parse(text)[0], set())
            assert time.process_time() - begin < 12

    def test_tags_end_outside_quotes(self):
        text = lambda s: html_template.text_of(html_template.parse(s)[0], set())[0]
        assert text('<a title="x > y">in</a> out') == "in out" and text("<p title='a\">'>b") == "b"
        assert text('<a title="no end>in') == '<a title="no end>in' and text("<br/>a<img src=x/>b") == "ab"
        assert text("<script/>a<!-- never closed") == "a" and text("a <3 b <? x ?> c") == "a <3 b c"

    def test_clashing_columns_and_empty(self, spark, pages):
        from pyspark.sql import functions as F

        odd = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "templates", "salt", "hash", "text")])
        assert rows_of(html_template.extracted(odd)) == rows_of(html_template.extracted(pages))
        assert html_template.extracted(pages.limit(0)).count() == 0


class TestUrls:
    def brute(self, units, top):
        """units: (host, domain, suffix, k, n); the posterior mean and weight of each host."""
        def level(rows):
            seen = [(k, n, m) for _, k, n, m in rows if n]
            q = sum(n * (k / n - m) ** 2 / (m * (1 - m)) for k, n, m in seen)
            d = sum(n - 1 for _, n, _ in seen)
            rho = min(max((q - len(seen)) / d, 0.001), 0.9) if d > 0 else 0.5
            s = 1 / rho - 1
            return {u: ((s * m + k) / (s + n), s + n) for u, k, n, m in rows}

        def total(key):
            out = defaultdict(lambda: [0, 0])
            for u in units:
                out[key(u)][0] += u[3]
                out[key(u)][1] += u[4]
            return out

        suffix = level([(s, k, n, top) for s, (k, n) in total(lambda u: u[2]).items()])
        domain = level([(d, k, n, suffix[d[1]][0]) for d, (k, n) in total(lambda u: (u[1], u[2])).items()])
        return level([(h, k, n, domain[d, s][0]) for h, d, s, k, n in units])

    def test_is_brute_force(self, spark):
        r = random.Random(1)
        suffixes = (*url_reputation.SUFFIXES, "example.com")
        hosts = [("www.bad.example.com", 0.9, 60), ("m.bad.example.com", 0.9, 2), ("www.good.example.com", 0.05, 60), ("m.good.example.com", 0.05, 3), ("one.co.uk", 0.3, 20), ("two.co.uk", 0.3, 0), ("solo", 0.5, 3)]
        rows, out = [], []
        for h, p, n in hosts:
            for _ in range(max(n, 1)):
                rows.append((len(rows), f"http://{h}/x", len(rows)))
                if n:
                    out.append((len(rows) - 1, int(r.random() < p)))
        pages, outcomes = spark.createDataFrame(rows, "page_id long, url string, key long"), spark.createDataFrame(out, "key long, bad int")
        bad = dict(out)
        units = []
        for h, _, _ in hosts:
            parts = h.split(".")
            suffix = ".".join(parts[-2:]) if ".".join(parts[-2:]) in suffixes else parts[-1]
            domain = ".".join(parts[-suffix.count(".") - 2 :])
            own = [bad[i] for i, u, _ in rows if u == f"http://{h}/x" and i in bad]
            units.append((h, domain, suffix, sum(own), len(own)))
        want = self.brute(units, (sum(bad.values()) + 0.5) / (len(bad) + 1))
        got = {r.host: r for r in url_reputation.reputation(pages, outcomes, suffixes).collect()}
        for h, (mean, weight) in want.items():
            assert got[h].mean == pytest.approx(mean)
            assert got[h].lower == pytest.approx(max(mean - 1.645 * math.sqrt(mean * (1 - mean) / (weight + 1)), 0))
        kept = {r.host: r.kept for r in url_reputation.filtered(pages, outcomes, suffixes=suffixes).collect()}
        assert not kept["www.bad.example.com"] and kept["www.good.example.com"] and got["m.bad.example.com"].mean > got["m.good.example.com"].mean

    def test_cases(self, spark):
        pages = spark.createDataFrame([(1, "http://a.com/", 1), (1, "http://a.com/", 1), (2, None, 2), (None, "??", None), (3, "HTTP://A.com:80/y", None)], "page_id long, url string, key long")
        none = spark.createDataFrame([], "key long, bad int")
        got = url_reputation.filtered(pages, none).collect()
        assert len(got) == 5 and all(r.kept for r in got) and {r.host for r in got} == {"a.com", ""}
        odd = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "key long, bad int")
        assert url_reputation.filtered(pages, odd).count() == 5
        assert url_reputation.filtered(pages.limit(0), odd).count() == 0

    def test_long_urls_clashing_columns_and_suffixes(self, spark):
        from pyspark.sql import functions as F

        rows = [(1, "http://a.com.sg/" + "x" * 1_000_000, 1), (2, "http://" + "h" * 100_000 + ".com/", 2), (3, "http://u:p@b.co.za/", 3), (4, "http://com.sg/", 4)]
        pages = spark.createDataFrame(rows, "page_id long, url string, key long")
        outcomes = spark.createDataFrame([(1, 1), (3, 0)], "key long, bad int")
        got = {r.page_id: r for r in url_reputation.filtered(pages, outcomes).collect()}
        assert got[1].host == "a.com.sg" and got[2].host == "h" * 100_000 + ".com"
        parts = {r.host: (r.domain, r.suffix) for r in pages.select(*url_reputation.parts_of(F.col("url"))).collect()}
        assert parts["a.com.sg"] == ("a.com.sg", "com.sg") and parts["b.co.za"] == ("b.co.za", "co.za") and parts["com.sg"] == ("com.sg", "com.sg")
        odd = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "domain", "suffix", "k", "n", "m", "mean", "bad", "seen", "lower", "kept")])
        assert rows_of(url_reputation.filtered(odd, outcomes)) == rows_of(url_reputation.filtered(pages, outcomes))


class TestTopK:
    def brute(self, docs, text, k):
        found = [(i, topk.words(t)) for i, t in docs if t and topk.words(t)]
        mean = sum(len(w) for _, w in found) / len(found)
        terms = set(topk.words(text))
        df = {t: sum(t in w for _, w in found) for t in terms}
        out = []
        for i, w in found:
            c = Counter(w)
            s = sum(math.log(1 + (len(found) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in sorted(terms) if c[t])
            if round(s, 6) > 0:
                out.append((-round(s, 6), i is None, i or 0, i))
        return [(r, x[3], -x[0]) for r, x in enumerate(sorted(out)[:k], 1)]

    def test_is_brute_force(self, spark, monkeypatch):
        monkeypatch.setattr(topk, "BLOCK_DOCS", 8)
        docs = [(i, prose(i % 150, 5 + i % 37)) for i in range(200)] + [(None, prose(3, 9)), (500, None), (501, ""), (3, prose(3, 8)), (502, prose(9, 30_000))]
        asked = [(1, prose(3, 6)), (2, prose(77, 4)), (3, ""), (4, None), (5, "zzzzz"), (1, "th an"), (None, "an")]
        got = defaultdict(list)
        for r in topk.top_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string"), k=7).collect():
            got[r.item_id].append((r.rank, r.doc_id, r.score))
        for item, text in ((2, prose(77, 4)),):
            assert [(a, b) for a, b, _ in sorted(got[item])] == [(a, b) for a, b, _ in self.brute(docs, text, 7)]
        assert sorted(got[1], key=repr) == sorted(self.brute(docs, prose(3, 6), 7) + self.brute(docs, "th an", 7), key=repr)
        assert set(got) <= {1, 2}

    def test_blocks_are_skipped_and_columns_may_clash(self, spark, monkeypatch):
        from pyspark.sql import functions as F

        monkeypatch.setattr(topk, "BLOCK_DOCS", 8)
        topk.PRUNED.clear()
        docs = [(i, prose(i, 30) + (" zebra" * (1 + i % 3) if i % 100 == 7 else "")) for i in range(400)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        asked = spark.createDataFrame([(1, "zebra zebra"), (2, "zebra")], "item_id long, text string")
        got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in topk.top_documents(df, asked, k=2).collect())
        assert [(i, *x) for i in (1, 2) for x in self.brute(docs, "zebra", 2)] == got
        assert topk.PRUNED["blocks"] >= 50 and topk.PRUNED["scored"] <= 10
        odd = df.select("*", *[F.lit("x").alias(c) for c in ("block", "place", "score", "rank", "item_id", "terms", "bound")])
        assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in topk.top_documents(odd, asked.withColumn("rank", F.lit(1)), k=2).collect()) == got

    def test_empty_and_passes(self, spark, documents, empty, monkeypatch):
        asked = spark.createDataFrame([(1, "two words"), (2, prose(1, 5))], "item_id long, text string")
        assert topk.top_documents(empty, asked).count() == 0 and topk.top_documents(documents, asked.limit(0)).count() == 0
        once = rows_of(topk.top_documents(documents, asked))
        monkeypatch.setattr(topk, "QUERIES_A_PASS", 1)
        assert rows_of(topk.top_documents(documents, asked)) == once


class TestEmbeddings:
    def brute(self, rows, width, threshold=0.9):
        """Every pair in double precision; components by relabelling."""
        all_ = [(i, np.array(v, float)) if v and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v) else (i, None) for i, v in rows]
        sizes = [None if v is None else v / np.abs(v).max() for _, v in all_]
        links, label = [0] * len(all_), list(range(len(all_)))
        for k, a in enumerate(sizes):
            for j in range(k + 1, len(sizes)):
                b = sizes[j]
                if a is not None and b is not None and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[k], links[j] = links[k] + 1, links[j] + 1
                    old, new = label[j], label[k]
                    label = [new if x == old else x for x in label]
        least = {}
        for (i, _), g in zip(all_, label, strict=True):
            least[g] = i if least.get(g) is None or i is not None and i < least[g] else least[g]
        return sorted(((i, least[g], n) for (i, _), g, n in zip(all_, label, links, strict=True)), key=repr)

    def rows(self):
        r = np.random.default_rng(3)
        base = r.normal(size=(120, 24))
        chain = np.cumsum(np.concatenate([base[:1], r.normal(scale=0.3, size=(20, 24))]), axis=0)
        x = np.concatenate([base, base[:30] + r.normal(scale=0.05, size=(30, 24)), base[:10], base[:5] * 7, chain]).astype(np.float32)
        odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [1.0] * 3), (904, [float("nan")] * 24), (905, [None] + [1.0] * 23), (None, x[3].tolist()), (None, [-1.0] * 24), (0, x[0].tolist())]
        return [(i, v.tolist()) for i, v in enumerate(x)] + odd

    @pytest.mark.parametrize(("tile", "guests"), [(8192, 8), (64, 1), (64, 2)])
    def test_is_brute_force(self, spark, monkeypatch, tile, guests):
        rows = self.rows()
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        monkeypatch.setattr(embed_dedup, "BLOCK", 16)
        monkeypatch.setattr(embed_dedup, "GUESTS", guests)
        got = sorted(((r.vec_id, r.class_id, r.links) for r in embed_dedup.near_classes(df, 0.9, tile=tile).collect()), key=repr)
        assert got == self.brute(rows, 24) and max(n for _, _, n in got) > 3

    def test_one_hot_cell_of_many_tiles(self, spark):
        r = np.random.default_rng(5)
        x = 1 + r.normal(scale=0.35, size=(500, 8))
        rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = sorted(((v.vec_id, v.class_id, v.links) for v in embed_dedup.near_classes(df, tile=64).collect()), key=repr)
        assert got == self.brute(rows, 8)

    def test_every_pair_of_tiles_meets_once(self):
        r = random.Random(1)
        cells = [(a, b, r.randint(1, 900)) for a in range(-2, 3) for b in range(-2, 2) if r.random() < 0.8]
        table = {(a, b): (n, total, homes) for a, b, n, total, homes in embed_dedup._tiles(cells, 64)}
        met, places = Counter(), defaultdict(set)
        for (a, b), (n, _, homes) in table.items():
            for own in range(n):
                for a2, b2, n2, offset in homes:
                    itself = (a2, b2) == (a, b)
                    for t in range(own if itself else n2):
                        met[(a2, b2, t), (a, b, own)] += 1
                        place = own - t - 1 if itself else offset - t + own
                        assert place not in places[a2, b2, t]
                        places[a2, b2, t].add(place)
        near = {((a, b, s), (c, d, t)) for (a, b), (n, _, _) in table.items() for (c, d), (m, _, _) in table.items() if abs(a - c) < 2 and abs(b - d) < 2 for s in range(n) for t in range(m) if (a, b, s) < (c, d, t)}
        assert set(met) == near and set(met.values()) <= {1}
        assert all(places[a, b, t] == set(range(total - t)) for (a, b), (n, total, _) in table.items() for t in range(n))

    def test_empty_clashing_huge_and_two_dimensions(self, spark):
        from pyspark.sql import functions as F

        none = spark.createDataFrame([], "vec_id long, embedding array<float>")
        assert embed_dedup.near_classes(none).count() == 0
        flat = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99e200, 0.05e200]), (3, [-1.0, 0.0]), (None, [1e-200, 0.01e-200])], "vec_id long, embedding array<double>")
        want = [(1, 1, 2), (2, 1, 2), (3, 3, 0), (None, 1, 2)]
        assert sorted(((r.vec_id, r.class_id, r.links) for r in embed_dedup.near_classes(flat).collect()), key=repr) == sorted(want, key=repr)
        odd = flat.select("*", *[F.lit("x").alias(c) for c in ("nid", "h1", "h2", "a", "b", "tile", "links", "root", "class_id", "copies", "least", "home")])
        assert rows_of(embed_dedup.near_classes(odd)) == rows_of(embed_dedup.near_classes(flat))
        named = spark.createDataFrame([("b", [1.0, 1.0]), ("a", [1.0, 1.0]), ("c", None)], "vec_id string, embedding array<double>")
        assert rows_of(embed_dedup.near_classes(named)) == sorted(map(repr, [("a", "a", 1), ("b", "a", 1), ("c", "c", 0)]))

    def test_query_is_its_sql_where_vectors_link(self, spark, tmp_path):
        import duckdb

        from sylvan.llm import entries

        rows = [(i, v) for i, v in self.rows()[:186]]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
        got = sorted((r.vec_id, r.class_id, r.links) for r in entries.op6_embedding_near_dedup(spark, str(tmp_path)).collect())
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert got == sorted(con.execute(entries.ORACLE["op6_embedding_near_dedup"]).fetchall()) and max(n for _, _, n in got) > 3


class TestArchives:
    def test_pages_become_responses_and_revisits(self, spark, pages, tmp_path):
        got = warc.deduplicated(pages, f"file://{tmp_path}").collect()
        assert len(got) == pages.distinct().count()
        by = {r.page_id: r for r in got}
        assert by[1].warc_type == "response" and (by[24].warc_type, by[24].refers_to, by[25].refers_to) == ("revisit", 1, 1)
        assert by[22].refers_to == 21 and by[22].warc_type == "revisit"
        bodies = {}
        for f in sorted(tmp_path.glob("*.warc.gz")):
            for _, h, block in warc.records(io.BytesIO(f.read_bytes())):
                if h["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    assert h["warc-payload-digest"] == warc.digest_of(payload) and h["warc-block-digest"] == warc.digest_of(block)
                    bodies[int(h.get("warc-page-id", -1))] = payload.decode()
        assert bodies[1] == [r.html for r in pages.collect() if r.page_id == 1][0] and not list(tmp_path.glob("_*"))

    def test_resolution(self, spark):
        rows = [("1", "u1", "response", "2024-01-02", "d1"), ("2", "u2", "response", "2024-01-01", "d1"), ("3", "u3", "revisit", "2023-01-01", "d1"), ("4", "u4", "revisit", "2024-01-01", "lost"), ("5", None, "response", "2024-01-01", "d2")]
        heads = spark.createDataFrame(rows, "page_id string, url string, warc_type string, date string, payload_digest string")
        got = {r.page_id: r.original and r.original.page_id for r in warc.resolved(heads).collect()}
        assert got == {"1": "2", "2": "2", "3": "2", "4": None, "5": "5"}

    def test_reading(self):
        one, two = warc.record("response", [("WARC-Target-URI", "u")], warc.http(b"x" * 3_000_000)), warc.record("revisit", [("WARC-Target-URI", "v")], b"")
        zipped = [(h["warc-type"], len(b)) for _, h, b in warc.records(io.BytesIO(one + two))]
        plain = [(h["warc-type"], len(b)) for _, h, b in warc.records(io.BytesIO(gzip.decompress(one) + gzip.decompress(two)))]
        assert zipped == plain and [k for k, _ in zipped] == ["response", "revisit"]
        assert len(list(warc.records(io.BytesIO(one + two[:20])))) == 1 and list(warc.records(io.BytesIO(b""))) == []

    def test_empty(self, pages):
        assert warc.deduplicated(pages.limit(0)).count() == 0

    def test_header_values_come_back(self):
        for value in ["a\r\nWARC-Type: metadata", " outer ", "\t", "", "caf\u00e9 100%25", "\u00a0x\u2028", "x" * 100_000, "\x00"]:
            (_, h, _), = warc.records(io.BytesIO(warc.record("response", [("WARC-Target-URI", value), ("WARC-Page-ID", "7")], b"")))
            assert h["warc-target-uri"] == value and h["warc-type"] == "response" and h["warc-page-id"] == "7"

    @pytest.mark.parametrize("stored_first", [False, True])
    def test_odd_urls_ids_ties_and_columns(self, spark, tmp_path, stored_first):
        from pyspark.sql import functions as F

        rows = [("p10", "http://x/\r\nWARC-Type: metadata\r\n", "one"), ("p9", " http://y ", "one"), (None, "http://z", "two"), (None, None, "two"), ("p1", None, "two"), ("p10", "http://x/\r\nWARC-Type: metadata\r\n", "one"), ("x" * 50, "u", None), ("q", "u", "")]
        df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
        if stored_first:
            df.write.parquet(f"{tmp_path}/pages")
            df = spark.read.parquet(f"{tmp_path}/pages")
        odd = df.select("*", *[F.lit("x").alias(c) for c in ("file", "at", "bucket", "copies", "keep", "payload_digest", "original", "o_id", "_metadata")])
        got = sorted(repr((r.page_id, r.url, r.warc_type, r.payload_length, r.refers_to)) for r in warc.deduplicated(odd).collect())
        want = [(rows[0][0], rows[0][1], "response", 3, None), ("p9", " http://y ", "revisit", 3, "p10"), ("p1", None, "response", 3, None), (None, "http://z", "revisit", 3, "p1"), (None, None, "revisit", 3, "p1"), ("q", "u", "response", 0, None), ("x" * 50, "u", "revisit", 0, "q")]
        assert got == sorted(map(repr, want))
        numbers = spark.createDataFrame([(2.5, "u", "a"), (10.0, "v", "a")], "page_id double, url string, html string")
        assert {(r.page_id, r.warc_type, r.refers_to) for r in warc.deduplicated(numbers).collect()} == {(2.5, "response", None), (10.0, "revisit", 2.5)}

    def test_archives_with_revisits_become_deduplicated_archives(self, spark, tmp_path):
        own = lambda page, url, date, payload: [("WARC-Page-ID", page), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", warc.digest_of(payload)), ("WARC-Record-ID", warc.urn(page))]
        a, b, big = b"alpha", b"beta", b"c" * 3_000_000
        first = warc.record("warcinfo", [], b"about") + warc.record("response", own("1", "u1", "2024-01-02", a), warc.http(a)) + warc.record("revisit", own("2", "u\n2", "2024-01-03", b), b"") + warc.record("response", own("3", "u3", "2024-01-01", big), warc.http(big))
        second = warc.record("response", own("4", "u4", "2024-01-01", a), b"HTTP/1.1 200 OK\r\nX-Own: kept\r\n\r\n" + a) + warc.record("response", own("5", "u5", "2024-01-05", b), warc.http(b)) + warc.record("revisit", [*own("6", "u6", "2024-01-01", b"lost"), ("WARC-Refers-To-Target-URI", "gone"), ("WARC-Refers-To-Date", "2020-01-01")], b"")
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.warc.gz").write_bytes(first)
        (tmp_path / "in" / "b.warc").write_bytes(gzip.decompress(second))
        (tmp_path / "in" / "c.warc.gz").write_bytes(warc.record("response", own("1", "u1", "2024-01-02", a), warc.http(a)))
        paths = spark.createDataFrame([(f"file://{tmp_path}/in/{n}",) for n in ("a.warc.gz", "b.warc", "c.warc.gz", "a.warc.gz")], "path string")
        got = {r.page_id: r for r in warc.rewritten(spark, paths, f"file://{tmp_path}/out").collect()}
        assert {k: (r.warc_type, r.refers_to, r.payload_length) for k, r in got.items()} == {"1": ("revisit", "4", 5), "2": ("revisit", "5", 4), "3": ("response", None, 3_000_000), "4": ("response", None, 5), "5": ("response", None, 4), "6": ("revisit", None, None)}
        assert got["2"].url == "u\n2" and (got["6"].refers_to_uri, got["6"].refers_to_date) == ("gone", "2020-01-01") and len(got) == 6
        blocks = {h["warc-page-id"]: block for f in (tmp_path / "out").glob("*.warc.gz") for _, h, block in warc.records(io.BytesIO(f.read_bytes()))}
        assert blocks["4"].startswith(b"HTTP/1.1 200 OK\r\nX-Own: kept") and blocks["3"] == warc.http(big) and blocks["1"] == b""
        again = warc.rewritten(spark, spark.createDataFrame([(f"file://{f}",) for f in (tmp_path / "out").glob("*.warc.gz")], "path string"), f"file://{tmp_path}/again").collect()
        assert sorted((r.page_id, r.warc_type, r.refers_to) for r in again) == sorted((r.page_id, r.warc_type, r.refers_to) for r in got.values())
        assert warc.rewritten(spark, paths.limit(0), f"file://{tmp_path}/none").count() == 0


def test_republished_articles_stay_and_templates_go(spark):
    def own(i, article, nav="Home and all news", notice=""):
        return (i, f"https://a.example.com/en/{i}", f"<html><head><title>T{i}</title></head><body><nav><ul><li>{nav}</ul></nav><div>{notice}</div><article><h1>About {article} at length</h1><p>{prose(article, 30)}</p></article><footer>All rights of no. {i % 2}</footer></body></html>")

    rows = [own(i, i) for i in range(20)] + [own(20 + i, 7, nav=f"The shelf number {i}") for i in range(5)] + [own(3, 3)] * 4
    got = {r.page_id: r for r in html_template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(25):
        article = i if i < 20 else 7
        assert f"About {article} at length\n{prose(article, 30)}" in got[i].text and "All rights" not in got[i].text
    assert "Home and" not in got[3].text and got[3].deleted == 2
    # a notice longer than any article, on all pages, is nobody's content
    rows = [own(i, i if i < 20 else 7, notice=prose(99, 200)) for i in range(24)]
    got = html_template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.deleted == 3 and prose(99, 200) not in r.text and prose(r.page_id if r.page_id < 20 else 7, 30) in r.text for r in got)
