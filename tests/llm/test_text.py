"""Main text of pages, benchmark passages, and the pipeline."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideframe.llm import decontaminate, wrappers
from tideframe.llm.dom import match_trees, parse

from .fixtures import docs, odd_rows, words

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x = "</p><p>no";</script></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>{h}</h1><header>By A</header><p>{a}&amp;  b<br>c<p>{b}<form><input></form><div class="share">Share</div><p>Read more at example</p></article>
<aside>side {a}</aside><div id="comments"><p>nice {b}</p></div><footer>&copy; x</footer></body></html>"""


def test_wrapper_text(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h.example/{i}", PAGE.format(h=f"head {i}", a=words(rng, 20), b=words(rng, 15))) for i in range(12)]
    rows += [(90, None, None), (91, "odd", ""), (92, "http://one.example/", "<p>just <b>bo</b>ld&nbsp;text <i>x"), (93, "http://h.example/z", "<html><body></body></html>"), rows[0]]
    got = wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    import re

    for i in range(12):
        a, b = re.search(r"<p>(.*?)&amp;", rows[i][2])[1], re.search(r"<br>c<p>(.*?)<form>", rows[i][2])[1]
        assert by[i]["text"] == f"head {i} {a}& b c {b}" or by[i]["text"] == f"head {i} By A {a}& b c {b}", by[i]["text"]
        assert by[i]["n_chars"] == len(by[i]["text"])
    assert (by[90]["text"], by[91]["text"], by[92]["text"], by[93]["text"]) == ("", "", "just bold text x", "")
    none = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars string, host string, wrapper string")
    assert wrappers.extract_pages(none).count() == 0
    clash = spark.createDataFrame([(*rows[0], "a", "b", "c", "d")], none.schema)
    assert wrappers.extract_pages(clash).count() == 1


def test_copies_are_no_template(spark):
    """Pages that occur many times, or nearly so, are content all the same, however much of a host's pages they make."""
    rng = random.Random(12)
    page = "<html><body><div class='top'>Site name</div><div id='c'>{}</div></body></html>"
    texts = [[words(rng, 12) for _ in range(3 + i % 3)] for i in range(10)] + [[words(rng, 12) for _ in range(9)]]
    rows = [(i, f"http://h.example/{i}", page.format("".join(f"<p>{t}</p>" for t in ts))) for i, ts in enumerate(texts)]
    rows += [(100 + i, f"http://h.example/c{i}", rows[10][2]) for i in range(40)]
    rows += [(200 + i, "http://same.example/", rows[10][2]) for i in range(9)]
    near = {300 + i: [*texts[10][:8], words(rng, 12)] for i in range(60)}
    rows += [(i, "http://near.example/", page.format("".join(f"<p>{t}</p>" for t in ts))) for i, ts in near.items()]
    rows += [(400 + i, "http://near.example/", rows[i][2]) for i in range(3)]
    got = wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["page_id"]
        want = near[i] if i in near else texts[i - 400 if i >= 400 else i if i < 11 else 10]
        assert r["text"].removeprefix("Site name ") == " ".join(want), r
    pages = [r[2] for r in rows[:4]] + [rows[10][2]] * 2
    assert wrappers.induce(pages) == wrappers.induce(pages[:5])
    a, b, c = ("".join(f"<div><p>{words(rng, 9)}</p></div>" for _ in range(6)) for _ in range(3))
    wrapper = wrappers.induce([a + " "] + [a + " " * i for i in range(6)] + [b, c])
    assert [wrappers.extract(x, wrapper) for x in (a, b, c)] == [wrappers.extract(x, None) for x in (a, b, c)] != [""] * 3


def plain_wrapper_text(pages):
    """What pages of one layout vary in: all leaf texts, by their path of child numbers, but those that all pages share."""
    from collections import defaultdict

    leaves = []
    for page in pages:
        found, stack = {}, [(parse(page), ())]
        while stack:
            node, way = stack.pop()
            if node.tag in ("script", "style"):
                continue
            for i, c in enumerate(node.children):
                if isinstance(c, str):
                    if c.strip():
                        found[*way, i] = " ".join(c.split())
                else:
                    stack.append((c, (*way, i)))
        leaves.append(found)
    values = defaultdict(list)
    for found in leaves:
        for way, text in found.items():
            values[way].append(text)
    return [" ".join(t for w, t in sorted(found.items()) if not (len(values[w]) == len(pages) and len(set(values[w])) == 1)) for found in leaves]


BARE = """<html><body><div>Site {n}</div><div><p>Posted in News</p><div>{a}</div><p>{b}</p><p>{c}<i>Read more</i></p><p>Subscribe now</p></div><div>Contact us</div><script>var a{n};</script></body></html>"""


def test_wrappers_without_names_of_elements(spark):
    """Pages without article elements or telling classes: alignment alone parts menus and constant lines from the text."""
    rng = random.Random(21)
    rows = [(i, f"https://bare.example/{i}", BARE.format(n=i % 2, a=words(rng, 30), b=words(rng, 25), c=words(rng, 9))) for i in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain_wrapper_text([r[2] for r in rows])
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(frame).collect()}
    for i, text in enumerate(want):
        assert got[i] == text.removeprefix(f"Site {i % 2} "), (got[i], text)
        assert wrappers.extract(rows[i][2], None) != got[i]


def test_what_a_host_repeats_inside_its_articles_stays(spark):
    """A common sentence, heading or list entry is part of the text, with article elements and without."""
    rng = random.Random(8)
    shared = "<h2>Background</h2><ul><li>Salt</li></ul><p>All of our stories end with these very words.</p>"
    for tag in ("article", "div"):
        rows = [(i, f"http://{tag}.example/{i}", f"<html><body><div>Our site</div><{tag}><p>{words(rng, 30)}</p><p>{words(rng, 20)}</p>{shared}</{tag}><div>Call us today</div></body></html>") for i in range(9)]
        frame = spark.createDataFrame(rows, "page_id long, url string, html string")
        for r in wrappers.extract_pages(frame).collect():
            want = " ".join(re.sub("<[^>]*>", " ", re.search(f"<{tag}>(<p>.*)</{tag}><div>", rows[r["page_id"]][2])[1]).split())
            assert r["text"] == want


def test_table_pages_by_alignment_alone(spark):
    """The article of every page of the table, found with its elements' names taken away."""
    import re
    from collections import defaultdict

    hosts = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect():
        hosts[re.search("://([^/?#:]+)", r["url"])[1]].append(r["html"])
    checked = 0
    for pages in hosts.values():
        bare = [re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", p).replace('<div class="ad">', "<div>") for p in pages]
        if len(pages) < 3:
            continue
        wrapper = wrappers.induce(bare[: wrappers.SAMPLED])
        for whole, page in zip(pages, bare, strict=True):
            assert wrappers.extract(page, wrapper) == wrappers.extract(whole, None) != wrappers.extract(page, None)
            checked += 1
    assert checked > 150


def test_registered_query_reads_all_pages(spark):
    import re

    from tideframe.llm import queries

    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.op8_wrapper_text(spark, folder).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        whole = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        import html

        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", whole)).split()) or "<" in html.unescape(whole)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("part", ['<p class="x>t ', "<div>", "<p title='a>b ", "<b><hr>", "<a b ", "<!x ", "<!-- ", "</b ", "<p><td><b>", "<li><b>", "<svg>", "< a"])
def test_odd_pages_take_linear_time(part):
    """Pages of 200,000 unclosed parts: neither deep recursion nor time by the square."""
    import time

    page = "<body><p>first</p>" + part * (200_000 // len(part))
    began = time.perf_counter()
    wrapper = wrappers.induce([page, page + "<p>other</p>", "<p>more</p>" + page[18:]])
    for w in (None, wrapper, {"path": [["body", None]], "heed": True, "constants": [[1, 1]]}):
        wrappers.extract(page, w)
    assert time.perf_counter() - began < 20


def test_wide_pages_are_aligned_in_bounded_time():
    page = lambda x: "<body>" + "".join(f"<p>{x}{i}<b>b</b></p>" for i in range(20_000)) + "<p>same</p>"
    wrapper = wrappers.induce([page("a"), page("b"), page("c")])
    assert wrapper["path"] == [["body", None]]
    assert wrappers.extract(page("d"), wrapper).startswith("d0")


def test_hints_do_not_hide_the_page():
    page = '<html><body class="menu-open has-sidebar"><article class="post comments-open"><p>text one</p></article><div class="comments">no</div></body></html>'
    assert wrappers.extract(page, None) == "text one"
    two = "<html><head><title>t</title><body><article>a</article><article class='comment'>c</article><article>b</article>"
    assert wrappers.extract(two, None) == "a b"
    rng = random.Random(3)
    odd = ["<body><div class='site-share widget'><div><p>" + "<p>".join(words(rng, 20) for _ in range(4)) + "</div></div><div>x</div>" for _ in range(5)]
    assert len(wrappers.extract(odd[0], wrappers.induce(odd))) > 300  # nearly all text lies in the class


def test_tree_matching():
    a, b = parse("<ul><li>1<li>2<li>3</ul><p>x"), parse("<ul><li>1<li>3</ul><p>y<p>z")
    size, pairs = match_trees(a, b)
    assert size == len(pairs) == 5


def plain_distance(item, text):
    """Fewest edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 140)))
        assert decontaminate.best_match(decontaminate.character_masks(item), len(item), text)[0] == plain_distance(item, text)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_match_places_hold_the_match():
    """Slices of matches: the item itself where no edit was needed, else a text at that very distance from it."""
    rng = random.Random(31)
    seen = set()
    for trial in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(20, 90)))
        item = decontaminate.normal(item)
        copy = list(item)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(copy) + 1)
            rng.choice([lambda: copy.insert(at, "z"), lambda: copy and copy.pop(min(at, len(copy) - 1)), lambda: copy.__setitem__(min(at, len(copy) - 1), "y")])()
        text = decontaminate.normal("".join(rng.choice("abc ") for _ in range(rng.randrange(60))) + "".join(copy) + "".join(rng.choice("abc ") for _ in range(rng.randrange(60))))
        for _, edits, start, end in decontaminate.Matcher(((1, item),), 0.1).matches(text):
            assert 0 <= start <= end <= len(text) and edit_distance(item, text[start:end]) == edits
            assert edits or text[start:end] == item
            assert all(edit_distance(item, text[s:end]) > edits for s in range(start + 1, end + 1))
            seen.add(edits)
    assert {0, 1, 2, 3} <= seen


def test_items_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, words(rng, 12)) for i in range(8)] + [(20, None), (21, ""), (None, "no id here at all"), (0, "Another text of item nought, quite long enough")]
    rows = []
    for i in range(105):
        text = words(rng, 30)
        if i % 3 == 0:
            item = list(items[i % 8][1])
            for _ in range(i % 7):
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice(["", "q", "qq"])
            text = f"{text} {''.join(item).upper()}\n{words(rng, 10)}"
        rows.append((i, text, None, None, None))
    rows += [(r[0] and r[0] + 1000, *r[1:]) for r in odd_rows() if r[0] != 0]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for r in rows:
        for i, t in items:
            t = decontaminate.normal(t)
            if i is not None and t:
                d = plain_distance(t, decontaminate.normal(r[1]))
                if d <= int(len(t) * decontaminate.ERROR_RATE):
                    want.add((r[0], i, d))
    for block in (8 << 20, 200):
        got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_items(docs(spark, rows), table, block_bytes=block).collect()}
        assert got == want
        kept = decontaminate.without_items(docs(spark, rows), table, block_bytes=block)
        assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _, _ in want}
    assert len(want) > 10
    assert {r["item_id"] for r in decontaminate.find_items(docs(spark, [(1, items[0][1] + " a", None, None, None)]), spark.createDataFrame([(0, items[0][1]), (1, "a")], "item_id long, text string"), shortest=5).collect()} == {0}
    big = spark.createDataFrame([(5, items[1][1] * 3), (6, items[2][1]), (7, items[3][1] * 4)], "item_id long, text string")
    found = decontaminate.find_items(docs(spark, [(i, t[1] * 4, None, None, None) for i, t in enumerate(items[:4])]), big, block_bytes=60).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 5), (2, 6), (3, 7)}
    assert decontaminate.find_items(docs(spark, []), table).count() == 0
    assert decontaminate.find_items(docs(spark), table.limit(0)).count() == 0
    assert decontaminate.without_items(docs(spark, clash=True), table).count() >= 1


def test_registered_matches(spark):
    """op10 over the whole table: every item that a text holds exactly is found, and each found one is within its budget."""
    from tideframe.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r["item_id"]: decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op10_edit_matching(spark, folder).collect()}
    exact = {(d, i) for d, text in texts.items() for i, item in items.items() if item and item in text}
    assert exact <= set(got)
    for (d, i), r in got.items():
        assert r["edits"] == plain_distance(items[i], texts[d][r["match_start"] : r["match_end"]]) <= int(len(items[i]) * decontaminate.ERROR_RATE)
        assert (r["edits"] == 0) == ((d, i) in exact)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (odd_rows(), []):
            made = stage(spark, docs(spark, rows), folder)
            assert made.columns == columns, name
            assert made.count() <= len(rows)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_keep_columns_of_clashing_names(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit("mine"), "accepted": F.col("doc_id"), "component_id": F.lit(1), "size": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, table, folder)
        assert made.columns == table.columns, name
        assert made.count() > 0 and made.where("score <> 'mine' or accepted <> doc_id or component_id <> 1").count() == 0, name


def test_pipeline_against_its_parts(spark):
    """The packed documents are those that plain versions of all stages keep."""
    import re

    import numpy as np

    from tideframe.llm import language, quality

    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    model = quality.fit(table, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score_documents(table, model).where("score >= 0.7").collect()}
    assert kept == {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, table, folder).collect()} and len(kept) > 100
    docs_ = table.where(F.col("doc_id").isin(list(kept)))
    known = language.fit(docs_)
    kept = {r["doc_id"] for r in language.predict(docs_, known).collect() if r["lang_pred"] != "und" and r["score"] >= known.least}
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i in sorted(kept):
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[i].translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    first = {i: i for i in sets}

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                first[max(x, y)] = min(x, y)
    kept = {i for i in ids if top(i) == i}
    assert len(kept) < len(ids)
    items = [t for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (t := decontaminate.normal(r["text"]))]
    exact = {i for i in kept if any(t in decontaminate.normal(texts[i]) for t in items)}
    packed = corpus_pipeline.run(spark, folder).select("doc_id", "length").toPandas()
    got = set(packed.doc_id)
    assert exact and not exact & got and got <= kept
    near = {r["doc_id"] for r in decontaminate.find_items(table, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert kept - got == kept & near
    assert np.isfinite(packed.length).all()


def test_duplicate_stage_keeps_one(spark):
    rng = random.Random(9)
    base = words(rng, 80)
    rows = [(i, base, "en", "s", 1) for i in (4, 2, 9)] + [(30, words(rng, 80), "en", "s", 1), (None, base, "en", "s", 1)]
    kept = corpus_pipeline.keep_first_of_group(spark, docs(spark, rows), "")
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 30, None]


def test_duplicate_stage_takes_four_fifths(spark):
    """Of 100 shingles each, 90 shared are a similarity of 0.82 and go; 88 shared are 0.79 and stay."""
    rng = random.Random(10)
    rows = []
    for i in range(0, 60, 3):
        base = words(rng, 104, 100_000).split()
        rows += [(i + d, " ".join([*(f"c{i}d{d}k{k}" for k in range(n)), *base[n:]]), "en", "s", 1) for d, n in enumerate((0, 10))]
        other = words(rng, 104, 100_000).split()
        rows += [(1000 + i + d, " ".join([*(f"c{i}e{d}k{k}" for k in range(n)), *other[n:]]), "en", "s", 1) for d, n in enumerate((0, 12))]
    kept = {r["doc_id"] for r in corpus_pipeline.keep_first_of_group(spark, docs(spark, rows), "").collect()}
    assert kept == {r[0] for r in rows} - {i + 1 for i in range(0, 60, 3)}


@pytest.mark.parametrize("name", ["quality"])
def test_quality_stage_keeps_clean_text(spark, name):
    folder = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.keep_quality(spark, table, folder).select("doc_id")
    clean = labels.where("quality = 1")
    assert clean.join(kept, "doc_id").count() > 0.98 * clean.count()
    junk = labels.where("quality = 0")
    assert junk.join(kept, "doc_id").count() < 0.1 * junk.count()
