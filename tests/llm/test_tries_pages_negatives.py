"""Prefix tries, page texts and hard negatives against brute force, odd rows and empty tables included."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyfold.llm import host_extract, packed_products, prefix_trie
from tallyfold.llm.queries import OP11_SQL, OP13_SQL, QUERIES

from brute import WORD

SF = "/root/testdata/sf0.01"


def digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: (x[0], x[1], digest(x[2])))] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        cost = (len(cs) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += cost
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["a b", "c", "", None, "d e f", "a  b\t", "é"]
    rows = []
    for c in [*range(n), -3, -20, 1005, 40_000]:
        kind = rng.random()
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randint(1, most))]
        if kind < 0.4:
            turns = [("user", "hot"), ("assistant", "same words here")][:rng.randint(1, 2)] + turns[:rng.randint(0, 3)]
        elif kind < 0.6:
            turns = [("user", "copy")] * (most - 1)
        for i, (role, text) in enumerate(turns):
            rows.append((c, rng.choice([None, i, i, i]), role, text))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def trie_rows(spark, rows):
    schema = "conv_id long, turn int, role string, text string, c long, r string, d int, w string, h long, sk string, seg int, root string"
    df = spark.createDataFrame([(*r, 7, "x", 1, "y", 2, "z", 3, "q") for r in rows], schema)
    return prefix_trie.prefix_trie(df)


def test_trie_is_brute_force(spark):
    rows = conversations(1, 80, 6)
    out = trie_rows(spark, rows)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_trie(rows)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_long_conversations_is_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 6)
    rows = conversations(6, 40, 16)
    assert sorted((tuple(r) for r in trie_rows(spark, rows).collect()), key=repr) == brute_trie(rows)


def test_trie_of_one_conversation_with_most_rows(spark):
    """Its turns lie in several tasks of the sort."""
    rows = [(5, i, "user", f"t{i % 50}") for i in range(600)] + [(6, 0, "user", "x"), (4, 2, None, "y")]
    assert sorted((tuple(r) for r in trie_rows(spark, rows).collect()), key=repr) == brute_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie.prefix_trie(empty).count() == 0
    only = spark.createDataFrame([(None, 1, "user", "x")], empty.schema)
    assert prefix_trie.prefix_trie(only).count() == 0


def test_ids_that_end_at_one_node_come_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(1500)]
    got = trie_rows(spark, rows).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_trie(rows)


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in (("op11_prefix_trie", OP11_SQL), ("op13_packed_negatives", OP13_SQL)):
        got, want = QUERIES[name].plan(spark, SF).toArrow(), con.sql(sql).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        rows = [sorted(zip(*(t.column(c).to_pylist() for c in sorted(t.column_names))), key=repr) for t in (got, want)]
        assert rows[0] == rows[1] and rows[0]


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def text_of(source):
    found = host_extract.Page(source)
    return found.text(np.zeros(len(found.tokens), bool))


@pytest.mark.parametrize("source, want", [
    (page("<nav>m</nav><article><h1>T</h1><p>a &amp; b<br>c</p></article><footer>f</footer>"), "T\na & b c"),
    (page("<main><p>x</p><aside>no</aside><form>no</form><div class='ad'>no</div><p>y</main>"), "x\ny"),
    (page("<main>out<article><header>Top</header>in<footer>no</footer></article></main>"), "Top\nin"),
    (page("<article><p>a<script>if (1 < 2) {'</p>'}</script> b<span class=\"ads\">buy <i>it</i></span> c</article>"), "a b c"),
    (page("<article>one<article class='comment'>reader</article><section id=\"comments\"><p>no</section>two</article>"), "one\ntwo"),
    (page("<header>site</header><div class='cookie-banner'>ok?</div><p>only <b>te</b>xt &lt;p&gt;</p><div role=navigation>m</div>"), "only text <p>"),
    ("<article><p><b>open<br><p>next</p></article><footer>f", "open\nnext"),
    ("<article>a<!-- <p>no</p> -->b<!-->c<ul><li>x<li>y</ul>d < e <3 &copy; &nbsp; z <p class", "abc\nx\ny\nd < e <3 © z"),
    ("plain words \n only", "plain words only"), ("", ""), (" \n", ""), ("<article></article><p>left</p>", "left"),
    (page("<article><table><tr><td>1<td>2<tr><td>3</table><pre>p\n q</pre></article>"), "1\n2\n3\np q"),
])
def test_text_of_a_page(source, want):
    assert text_of(source) == want


def test_repeated_tokens_are_those_of_shared_windows():
    rng = random.Random(3)
    shared = [rng.choice("abcdef") for _ in range(30)]
    streams = [[rng.choice("abcdef") for _ in range(rng.randint(0, 60))] for _ in range(20)]
    streams = [s + shared[rng.randint(0, 10): rng.randint(15, 30)] + s[:5] for s in streams] + [shared, shared, []]
    marks = host_extract.repeated_tokens(host_extract.numbered(streams))
    owners, k = defaultdict(set), host_extract.WINDOW
    for s in streams:
        for i in range(len(s) - k + 1):
            owners[tuple(s[i:i + k])].add(tuple(s))
    for s, mark in zip(streams, marks):
        want = set()
        for i in range(len(s) - k + 1):
            if len(owners[tuple(s[i:i + k])]) > 1:
                want |= set(range(i, i + k))
        assert set(np.flatnonzero(mark).tolist()) == want


def undecided_pages():
    rng = random.Random(4)
    pages = []
    for i in range(30):
        words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        body = f"<div><div>Subscribe to our weekly letter and get all the news first today</div><div><p>{words}</p></div><div>All rights reserved by this company and all of its partners</div></div>"
        pages.append((i, f"https://u:p@Host.example:80/{i}", page(body), words))
    return pages


@pytest.mark.parametrize("part_bytes", [1 << 20, 2000])
def test_boilerplate_without_markup_is_found_over_the_host(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(host_extract, "PART_BYTES", part_bytes)
    pages = undecided_pages()
    rows = [p[:3] for p in pages] + [pages[0][:3], (90, "http://other.example", pages[1][2]), (91, None, None), (92, "x", ""), (None, None, "<p>free")]
    rows += [(93, "https://host.example/a", page("<article><p>Subscribe to our weekly letter and get all the news first today</p></article>"))]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], "page_id long, url string, html string, part int, host string, parts int, text string")
    got = host_extract.main_texts(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert all(texts[i] == words for i, _, _, words in pages)
    # Alone on its host, nothing is repeated.
    assert texts[90].startswith("Subscribe") and texts[91] == texts[92] == "" and texts[None] == "free"
    assert texts[93].startswith("Subscribe")
    assert host_extract.main_texts(df.limit(0)).count() == 0


def test_a_divided_host_gives_what_an_undivided_one_does(spark, monkeypatch):
    """Boilerplate of a page without markup that only pages with an article have, copies, and counts over the host."""
    rng = random.Random(9)
    shared = "All rights reserved by this company and all of its many partners"
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, "http://big.example/", page(f"<article><p>{words(30)}</p><p>{shared}</p></article>")) for i in range(25)]
    alone = words(40)
    rows += [(50, "http://big.example/u", page(f"<div>{shared}</div><div>{alone}</div>"))]
    # Copies of one stream repeat nothing, in one part or in several.
    copy = words(60)
    rows += [(100 + i, "http://copies.example/", f"<p title={i}>{copy}") for i in range(40)]
    rows += [(200 + i, "http://small.example/", page(f"<p>{words(5)}</p>")) for i in range(2)]
    rows += [(300, "http://big.example/", None), (301, "http://big.example/", "few words"), (302, "http://long.example", "x " * 5_000), (303, "http://long.example", "x " * 6_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(host_extract, "PACKED", 500)
    got = {}
    for part_bytes in (1 << 20, 1500):
        monkeypatch.setattr(host_extract, "PART_BYTES", part_bytes)
        got[part_bytes] = sorted(map(tuple, host_extract.main_texts(df).collect()), key=lambda r: r[0])
    assert got[1500] == got[1 << 20] and len(got[1500]) == len(rows)
    by_id = {r[0]: r for r in got[1500]}
    assert by_id[50][2] == alone and by_id[100][4] == 0 and by_id[100][2] == copy and by_id[302][4] == 5_000 and by_id[0][4] > 10


def test_names_cost_few_bytes_however_many_lots_there_are():
    """A page has less than one name in each of many lots; streams and homes are not repeated with every name."""
    rng = np.random.default_rng(5)
    pages = [(int(rng.integers(50)), i, np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2))) for i in range(500)]
    rows = list(host_extract._packed("h", 600, list(pages)))
    n = sum(len(p[2]) for p in pages)
    assert sum(len(b) for r in rows for b in r[1:]) < 25 * n
    got = set()
    for key, names, places, streams, homes in rows:
        names, places, streams, homes = host_extract.from_gaps(names), *(np.frombuffer(b, t) for b, t in ((places, np.uint16), (streams, np.int64), (homes, np.int64)))
        got |= set(zip(names.tolist(), streams[places].tolist(), homes[places].tolist()))
    assert got == {(x, stream, home) for home, stream, own in pages for x in own.tolist()}
    # One lot at least: gaps of 64-bit names leave the last bytes empty.
    ((_, names, *rest),) = host_extract._packed("h", 1, list(pages))
    assert len(names) + len(rest[0]) <= 10 * n and not any(np.frombuffer(names, np.uint8).reshape(8, -1)[7, 1:])


def test_the_share_of_pages_that_is_exchanged_does_not_grow(spark):
    """Hosts from small to large: those that are cut hold the same share of a table and of ten times that table."""
    def share(times):
        rows = spark.range(40 * times).selectExpr("concat('h', id % 8) AS host", "repeat('x', 60000) AS html")
        cut = host_extract.divided_hosts(rows).collect()
        assert all(r.parts >= 2 for r in cut)
        return len(cut) / 8

    assert share(1) == share(10) == 1
    few = spark.createDataFrame([("a", "x" * 1000), ("b", None)], "host string, html string")
    assert host_extract.divided_hosts(few).count() == 0


def test_pages_of_the_table(spark):
    """Texts of the given pages, whose articles are plain, by a simple rule of their own."""
    import html
    import re

    got = QUERIES["op12_host_extract"].plan(spark, SF).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(source)
    for r in got:
        part = source[r.page_id].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", part)]
        assert r.text == "\n".join(b for b in blocks if b)


def brute_negatives(rows, positives=5, negatives=10):
    seen = {}
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            parts = [max(math.floor(256 * float(x)), -(2**63) + 1) if abs(256 * float(x)) < 2**63 else (2**63 - 1) * (1 if x > 0 else -1) for x in v]
            own = (label + 1) % 10 if k % 7 == 0 else label
            if k not in seen or (own, parts) < seen[k]:
                seen[k] = (own, parts)
    clip = lambda s: max(-(2**63), min(s, 2**63 - 1))
    out = []
    for a, (label, x) in seen.items():
        if a % 100:
            continue
        scores = [(-clip(sum(p * q for p, q in zip(x, y))), k, other) for k, (other, y) in seen.items() if k != a]
        near = sorted((s, k) for s, k, other in scores if other == label)[:positives]
        for s, p in near:
            far = sorted((t, k) for t, k, other in scores if other != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(a, p, i + 1, k, -s, -t) for i, (t, k) in enumerate(far)]
    return sorted(out)


def negatives(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, k long, c string, a int")
    df = df.where(packed_products.usable(F.col("label"), F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = df.withColumn("label", label).withColumn("parts", packed_products.quantised(F.col("embedding"), 256))
    out = packed_products.hard_negatives(df, F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in out.collect())


def test_negatives_are_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.normal(size=6) + (i % 3), 1).tolist(), int(i % 4)) for i in range(-200, 900)]
    rows += [rows[0], (100, [0.5] * 6, 0), (100, [0.25] * 6, 0), (None, [1.0] * 6, 1), (2000, None, 1), (2100, [1.0] * 6, None)]
    rows += [(2200, [float("nan")] * 6, 1), (2300, [1.0, None], 1), (2400, [float("inf")], 0), (2500, [], 2), (2600, [3.0], 2), (2700, [0.0] * 6, 1)]
    got = negatives(spark, rows)
    assert got == brute_negatives(rows) and got
    assert negatives(spark, []) == []
    assert negatives(spark, [(100, [1.0], 1)]) == []


def test_negatives_of_huge_components(spark):
    rows = [(i, [float(10.0 ** (i % 20 - 2)), float(i - 50), -float(10.0 ** (i % 7))], i % 2) for i in range(0, 400)]
    assert negatives(spark, rows) == brute_negatives(rows)


@pytest.mark.parametrize("most", [1, 255, 10**6, 2**40, 2**63 - 1])
def test_packed_scores_are_inner_products(most):
    rng = random.Random(most)
    parts = [[rng.randint(-most, most) for _ in range(5)] for _ in range(40)]
    parts[0], parts[1] = [most] * 5, [-most] * 5
    block = packed_products.Packed(np.arange(40), np.array(parts), most, packed_products.field_width(most, 5))
    for anchor in parts[:10]:
        want = [max(-(2**63), min(sum(a * b for a, b in zip(anchor, p)), 2**63 - 1)) for p in parts]
        assert block.scores(anchor).tolist() == want
