"""HTML, licences, URL lists, benchmark passages, embeddings and the pipeline."""

import datetime
import random

import duckdb
import numpy as np
import pytest

from textsketch.llm import decontaminate, htmltext, itq, licences, urlfilter
from textsketch.llm import queries as registry

PAGE = """<html><head><title>x</title></head><body class="home has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header><div id="menu"><ul><li>A<li>B</ul></div>
<div class="cookie-notice"><p>We use cookies on this site, accept all of them please now.</p></div><div class=content><h2>The title</h2>
<p>Long text here, about <i>something</i> &amp; long enough. %s</p><p>Second&nbsp;&lt;para&gt;\n graph<br>with many words in it to count.</p><form><input>Search</form><p>Tail.</p></div>
<script>if (a < b) document.write("<p>no</p>")</script><!-- <p>no</p> --><div class="sidebar"><p>Related links and more things that are not to be read by anyone at all.</p></div>
<section id="comments"><p>Great post! I loved it so much that I wrote this comment of some length.</p></section><footer>c 2024</footer></body></html>""" % ("word " * 30)
WANT = "The title\nLong text here, about something & long enough. " + ("word " * 30).strip() + "\nSecond <para> graph with many words in it to count.\nTail."


def test_main_text():
    assert htmltext.main_text(PAGE) == WANT
    article = "<nav>m</nav><article><header><h1>T</h1></header><p>One.<p>Two<aside>ad</aside></article><div>rest " + "x " * 90 + "</div>"
    assert htmltext.main_text(article) == "T\nOne.\nTwo"
    for cut in range(0, len(PAGE), 7):  # a page that ends anywhere
        assert "<p>" not in htmltext.main_text(PAGE[:cut])
    assert [htmltext.main_text(x) for x in (None, "", " ", "plain", "<p>a<p>b", "<article></article>")] == ["", "", "", "plain", "a\nb", ""]
    assert htmltext.main_text("<div class='ad'>only this</div>") == "only this"  # better than nothing


def test_extract(spark):
    df = spark.createDataFrame([(1, PAGE, "c"), (1, PAGE, "c"), (None, None, None), (2, "<p>é</p>" * 30_000, "d")], "page_id bigint, html string, main_text string")
    rows = htmltext.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, len(WANT)), (1, len(WANT)), (2, 59_999)]
    assert htmltext.extract(df.where("false")).count() == 0


def test_licences(documents):
    mit = licences.TEMPLATES["MIT"][1]
    text = "words of a text\n" + mit.replace(", including", ",\nincluding") + "\n\nlicensed UNDER the apache license version 1.1\n"
    rows = licences.scan(documents([(1, text), (2, None), (3, ""), (4, "word"), (5, "Released under the MIT License."), (5, "Released under the MIT License.")])).collect()
    got = sorted((r.doc_id, r.first_line, r.last_line, r.licence) for r in rows)
    assert (1, 4, 4, "Apache") in got and got.count((5, 0, 0, "MIT")) == 2 and {g[0] for g in got} == {1, 5}
    assert licences.scan(documents([])).count() == 0


def _slow_licences(text, templates, threshold=0.8):
    """All units and windows against all templates."""
    grams = lambda w: set(zip(w, w[1:]))  # noqa: E731, B905
    words, of, lines = [], [], text.split("\n")
    for k, line in enumerate(lines):
        own = licences.normalised(line)
        words, of = words + own, of + [k] * len(own)
    found = {}

    def put(a, b, dice, name):
        if dice >= threshold:
            found[a, b] = min((-dice, name), found.get((a, b), (-dice, name)))

    known = [(name, licences.normalised(t)) for name, texts in templates.items() for t in texts]
    for a, b in licences.units(lines):
        own = grams([w for w, k in zip(words, of, strict=True) if a <= k <= b])
        for name, w in known:
            put(a, b, 2 * len(own & grams(w)) / max(1, len(own) + len(grams(w))) if own else 0, name)
    for name, w in known:
        run = []
        for s in range(len(words) - len(w) + 1):
            own = grams(words[s : s + len(w)])
            dice = 2 * len(own & grams(w)) / max(1, len(own) + len(grams(w)))
            if dice >= threshold:
                if run and s - run[-1][1] > len(w):
                    d, at = min(run)
                    put(of[at], of[at + len(w) - 1], -d, name)
                    run = []
                run.append((-dice, s))
        if run:
            d, at = min(run)
            put(of[at], of[at + len(w) - 1], -d, name)
    return [(*k, v[1], -v[0]) for k, v in sorted(found.items())]


def test_licences_by_brute_force():
    templates = {"A": ["one two three four five", "six seven eight nine 10 eleven twelve"], "B": ["one two three four 5", "spdx id b"], "C": ["five five five five six"]}
    rng, model, n = random.Random(2), licences.Templates(templates, 0.8), 0
    every = sorted({w for texts in templates.values() for t in texts for w in t.split()})
    for _ in range(400):
        out = []
        for _ in range(rng.randint(0, 5)):
            own = rng.choice(rng.choice(list(templates.values()))).split()
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = rng.choice([*every, "x"])
            out += own + [rng.choice([*every, "x", "y", "z"]) for _ in range(rng.randint(0, 5))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", ", "]) for w in out)
        got = model.find(text)
        assert got == _slow_licences(text, templates), text
        n += len(got)
    assert n > 500


def test_notices_inside_longer_texts(documents, tmp_path):
    t = licences.TEMPLATES
    filler = "some other words of no licence that stand here, "
    texts = [
        (filler * 9 + t["MIT"][1] + filler * 9, "MIT"),
        (filler * 3 + "\n" + t["MIT"][1].replace("to deal", "to\ndeal").replace("merge", "\nmerge") + " " + filler * 5 + "\nand more", "MIT"),
        ("// SPDX-License-Identifier: Apache-2.0 OR x\n" + filler, "Apache"),
        (filler + next(x for x in t["Unlicense"] if x.startswith("Anyone")) + filler, "Unlicense"),
        (filler + next(x for x in t["Apache"] if x.startswith("Unless")) + filler, "Apache"),
        (filler + "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + filler, "GPL"),
    ]
    rows = licences.scan(documents([(k, x) for k, (x, _) in enumerate(texts)])).collect()
    assert all(any(r.doc_id == k and r.licence == want for r in rows) for k, (_, want) in enumerate(texts))
    assert not licences.scan(documents([(1, filler * 50)])).collect()
    (tmp_path / "Own_1.txt").write_text("You may do with this what pleases you, on Sundays only.")
    assert licences.scan(documents([(1, filler + "you may do with this what pleases you on Sundays only " + filler)]), licences.load(str(tmp_path))).first().licence == "Own"


@pytest.mark.parametrize("name", ["op5_url", "op8_licences"])
def test_registered_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = registry.QUERIES[name](spark, small)
    result = con.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


def test_urls_as_of(spark):
    d = datetime.date
    entries = [
        ("spam", "a.com", "add", d(2024, 1, 10)), ("spam", "a.com", "remove", d(2024, 1, 20)), ("spam", "a.com", "add", d(2024, 1, 20)), ("spam", "b.org/x/", "add", d(2024, 1, 1)),
        ("allow", "good.a.com", "add", d(2024, 1, 15)), ("spam", None, "add", d(2024, 1, 1)), ("spam", "c.net", "other", d(2024, 1, 1)), ("dup", "a.com", "add", d(2024, 1, 10)), ("dup", "a.com", "add", d(2024, 1, 10)),
    ]
    lists = spark.createDataFrame(entries, "list string, pattern string, action string, at date")
    urls = [
        (1, "http://a.com/", d(2024, 1, 9), False), (2, "https://www.A.com:8080/p?q#f", d(2024, 1, 10), True), (3, "http://u:p@good.a.com/", d(2024, 1, 16), False), (4, "http://good.a.com", d(2024, 1, 12), True),
        (5, "http://b.org/x/y", d(2024, 1, 2), True), (6, "http://b.org/xy", d(2024, 1, 2), False), (7, "http://sub.b.org/x/y", d(2024, 1, 2), False), (8, None, d(2024, 1, 2), False), (9, "http://a.com", None, False),
        (10, "no url", d(2024, 1, 12), False), (11, "http://nota.com", d(2024, 1, 12), False), (None, "http://a.com.", d(2024, 1, 12), True), (12, "//a.com/x", d(2024, 1, 12), True),
    ]
    captures = spark.createDataFrame(urls + urls[:2], "page_id bigint, url string, fetched_at date, blocked boolean")
    rows = urlfilter.judge(captures, lists).collect()
    want = {u[0]: u[3] for u in urls}
    assert len(rows) == 15 and {r.page_id: r.blocked for r in rows} == want
    assert {r.page_id: r.reasons for r in rows}[2] == "dup:a.com,spam:a.com"
    late = spark.createDataFrame([(1, "http://a.com", d(2024, 1, 20))], "page_id bigint, url string, fetched_at date")
    assert urlfilter.judge(late, lists).first().reasons == "dup:a.com"  # at one time, a removal wins
    assert urlfilter.judge(captures.where("false"), lists).count() == 0
    assert not any(r.blocked for r in urlfilter.judge(captures, lists.where("false")).collect())


def test_entries_without_a_last_slash(spark):
    """As in the SQL, an entry with a path holds for what begins with it."""
    d = datetime.date(2024, 1, 1)
    lists = spark.createDataFrame([("l", p, "add", d) for p in ("h.org/page.html", "h.org/spam", "i.or/x", "i.or", "j.org/a/")], "list string, pattern string, action string, at date")
    urls = {"http://h.org/page.html?q": True, "http://h.org/spam": True, "http://h.org/spam/x": True, "http://h.org/page.htm": False, "http://www.h.org/spam": False, "http://i.org/x": False, "http://j.org/a": False, "http://j.org/a/b": True}
    captures = spark.createDataFrame([(u, d) for u in urls], "url string, fetched_at date")
    assert {r.url: r.blocked for r in urlfilter.judge(captures, lists).collect()} == urls


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 10))
        want = min(_levenshtein(a.tolist(), b[s:e].tolist()) for s in range(len(b) + 1) for e in range(s, len(b) + 1))
        edits, start, end = decontaminate.align(a, b)
        assert edits == want == _levenshtein(a.tolist(), b[start:end].tolist())


def test_edited_passages_are_found(spark, documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 50)))) for k in range(60)]
    rows, planted = [], {}
    for k, (item, text) in enumerate(items * 3):
        own = text.split()
        for _ in range(int(len(own) * rng.choice([0, 0.1, 0.2]))):
            at, kind = rng.randrange(len(own)), rng.random()
            if kind < 0.5:
                own[at] = word()
            elif kind < 0.75:
                own.insert(at, word())
            else:
                del own[at]
        before, after = [word() for _ in range(rng.randint(0, 60))], [word() for _ in range(rng.randint(0, 60))]
        rows.append((k, " ".join(before + own + after).upper()))
        planted[k] = item
    rows += [(1000 + k, " ".join(word() for _ in range(200))) for k in range(50)] + [(2000, None), (2001, ""), (2002, "a"), (2003, "x " * 50_000)]
    bench = spark.createDataFrame([*items, (None, None), (99, "too short"), (98, "")], "item_id bigint, text string")
    got = decontaminate.matches(documents(rows), bench).collect()
    assert all(planted.get(r.doc_id) == r.item_id for r in got) and all(r.similarity >= 0.8 for r in got)
    assert len({r.doc_id for r in got}) >= 0.92 * len(planted)
    whole = documents(rows)
    left = decontaminate.clean(whole, bench)
    assert left.columns == whole.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {r.doc_id for r in got}
    assert decontaminate.matches(documents([]), bench).count() == 0
    assert decontaminate.clean(whole, bench.where("false")).count() == len(rows)


@pytest.mark.parametrize("least, most", [(5, 15), (15, 50), (60, 120)])
def test_all_passages_at_the_edit_limit_are_found(least, most):
    """Exactly as many edits as are allowed, in items of one range of lengths."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(least, most)))) for k in range(100)]
    items = decontaminate.Items().build(rows)
    for k, text in rows:
        own = text.split()
        for _ in range(int(decontaminate.EDITS * len(own))):
            at, kind = rng.randrange(len(own)), rng.random()
            own[at : at + (kind < 0.75)] = [] if kind < 0.25 else [word()]
        before, after = [word() for _ in range(rng.randint(0, 60))], [word() for _ in range(rng.randint(0, 60))]
        assert k in {x[0] for x in items.find(" ".join(before + own + after))}


@pytest.mark.parametrize("n", [10, 20, 40, 80, 120])
@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2])
def test_samples_meet_at_every_length_and_rate(n, rate):
    """The walks and samples alone, before anything else is aligned: window of the item's size at the passage's beginning or near it."""
    rng, met = np.random.default_rng(n), 0
    for _ in range(100):
        item = rng.permutation(4 * n)[:n]
        own = decontaminate.edited(item, int(rate * n), rng)
        t = np.concatenate([-1000 - np.arange(2 * n), own, -5000 - np.arange(2 * n)])
        at = 2 * n + np.arange(-int(0.2 * n), int(0.2 * n) + 1)
        met += decontaminate.meet(item, t[at[:, None] + np.arange(n)]).any()
    assert met >= 90, met


def _slow_matches(items, text):
    """Every stretch of the text against every item."""
    t, out = decontaminate.words(text), []
    for k, item in items:
        own = decontaminate.words(item)
        best = min(((_levenshtein(own, t[s:e]), e) for s in range(len(t) + 1) for e in range(s, min(len(t), s + 2 * len(own)) + 1)), default=(len(own) + 1, 0))
        if own and best[0] <= int(0.2 * len(own)):
            out.append((k, best[0]))
    return sorted(out)


def test_matches_by_brute_force():
    rng = random.Random(11)
    word = lambda n=9: rng.choice("abcdefghijklmnopqrs"[:n])
    found = 0
    for _ in range(60):
        items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 12])))) for k in range(5)]
        text = []
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word(19)
            text += own + [word(19) for _ in range(rng.randint(0, 6))]
        got = [(x[0], x[4]) for x in decontaminate.Items().build(items).find(" ".join(text))]
        assert got == _slow_matches(items, " ".join(text)), (items, text)
        found += len(got)
    assert found > 60


def test_short_repeated_and_odd_items(spark, documents):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "Alpha, beta"), (2, "alpha beta"), (None, "alpha beta"), (3, "gamma"), (4, "!"), (5, None), (6, "one two three four five six seven")], "item_id bigint, text string")
    docs = documents([(1, "so alpha beta it"), (1, "so alpha beta it"), (2, "alphabeta gamma"), (3, None), (4, "one two x four five six seven")])
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, bench).collect())
    assert got == sorted(2 * [(1, 1, 0), (1, 2, 0), (1, 2, 0), (1, -1, 0)] + [(2, 3, 0), (4, 6, 1)])
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 1, 2, 3]
    assert [r.doc_id for r in decontaminate.clean(docs, bench, least=1).collect()] == [3]


def test_blocks_of_items_find_the_same(spark, documents, monkeypatch):
    items = [(k, f"alpha{k} beta{k} gamma{k} delta{k} epsilon{k} zeta{k}") for k in range(7)]
    bench, docs = spark.createDataFrame(items, "item_id bigint, text string"), documents([(k, f"so {t} end") for k, t in items])
    want = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()) == want == [(k, k) for k in range(7)]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()) == want


def _vectors(n=300, d=24):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(n):
        x = rng.normal(size=d)
        rows.append((len(rows), x.tolist(), k % 3))
        for _ in range(rng.integers(0, 4)):
            y = x + rng.normal(size=d) * rng.choice([0.05, 0.2, 0.3])
            rows.append((len(rows), (y * 3).tolist(), k % 3))
    hot = rng.normal(size=d)
    for _ in range(150):
        rows.append((len(rows), (hot + rng.normal(size=d) * 0.02).tolist(), 1))
    for _ in range(40):  # copies of one, which is linked to others
        rows.append((len(rows), rows[0][1], rows[0][2]))
    return rows


@pytest.mark.parametrize("chunk", [1024, 32])
def test_embeddings_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(itq, "CHUNK", chunk)
    rows = _vectors()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    odd = [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 24, 1), (5003, [float("nan")] * 24, 1), (5004, [None, 1.0], 1), (5005, rows[0][1], None), (5006, [1.0], 0), (5007, [2.0], 0)]
    df = spark.createDataFrame([*rows, *odd, rows[0], (None, rows[0][1], 0)], "vec_id bigint, embedding array<double>, label int")
    got = itq.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd) + 2
    by = {r.vec_id: r for r in got}
    found = sum(by[k].n_links for k in range(len(rows)))
    assert all(by[k].n_links <= links[k].sum() for k in range(len(rows))) and found >= 0.9 * links.sum()
    assert all(by[k].n_links == 0 and by[k].component_id == k and by[k].kept for k in range(5000, 5006))
    assert by[5007].component_id == 5006 and not by[5007].kept and by[None].n_links == 0
    for r in got:
        if r.vec_id is not None and r.vec_id < len(rows):
            assert label[r.component_id] == label[r.vec_id] and r.kept == (r.component_id == r.vec_id)
    assert itq.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("common", [0.0, 0.7, 0.8, 0.99])
def test_embeddings_with_a_common_direction(common):
    """Pairs just above the threshold meet in some table, however long the mean of all vectors is."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    n, d, c = 4000, 64, 0.935
    x = (1 - common**2) ** 0.5 * unit(np.c_[np.zeros(n), rng.normal(size=(n, d - 1))])
    x[:, 0] = common
    own, other = x[:1000], x[1000:2000].copy()
    a = unit(own[:, 1:])
    b = rng.normal(size=a.shape)
    b = unit(b - (a * b).sum(axis=1)[:, None] * a)
    inner = max(-1.0, (c - common**2) / (1 - common**2))  # of the parts that aren't common
    other[:, 1:] = (1 - common**2) ** 0.5 * (inner * a + (1 - inner**2) ** 0.5 * b)
    assert ((own * other).sum(axis=1) >= 0.93).all()
    x[1000:2000] = other
    tables = itq.Tables(list(x), 15)
    recall = (tables.keys(own) == tables.keys(other)).any(axis=1).mean()
    assert recall >= 0.9, (recall, tables.width, tables.tables)


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small)
        assert after.columns == docs.columns
        left = after.collect()
        assert left and set(left) <= set(before.collect()), name
        before = spark.createDataFrame(left, docs.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, small).collect()}
    assert np.mean([(k in kept) == bool(q) for k, q in labels.items()]) > 0.95
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == {r.doc_id for r in before.collect()}
