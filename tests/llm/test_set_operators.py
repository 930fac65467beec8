"""Language ID, near and exact deduplication, URL filter and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import components, exact_dedup, langid, near_dedup, queries, url_filter
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], SCHEMA)


def union_find(n, links):
    top = {i: i for i in n}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}


# --- op6 ---------------------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = union_find(list(sets), links)
    return {i: (len(sets[i]), top[i], top[i] == i) for i in sets}


def near(spark, rows, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows), **kw).collect()}


def test_near_duplicates_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "One"), (10**6 + 4, "one"), (10**6 + 5, "É a"), (10**6 + 6, "é a")]
    assert near(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [4096, 5])
def test_near_duplicates_that_share_a_passage(spark, block):
    """A passage in all documents, most of it in some: buckets with many members that do not link, and chains of links."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(5, 60))] + passage)) for i in range(120)]
    base = [word() for _ in range(80)]
    for i in range(40):  # each is near the one before, the ends are far apart
        base = base[:]
        base[(7 * i) % 80 : (7 * i) % 80 + 1] = [word()]
        rows.append((1000 + i, " ".join(base)))
    rows += [(2000 + i, rows[0][1].upper()) for i in range(5)]
    assert near(spark, rows, block=block) == brute(rows)


@pytest.mark.parametrize("block", [2, 12])
def test_near_duplicates_with_frequent_rare_shingles(spark, block):
    """Texts made of a few shared passages: keys of the prefix filter are frequent and go through second and third shingles."""
    rng, rows = random.Random(9), []
    passages = [" ".join(f"p{k}w{j}" for j in range(9)) for k in range(7)]
    for i in range(140):
        parts = rng.sample(passages, rng.randrange(1, 6))
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), " ".join(f"own{i}x{j}" for j in range(rng.randrange(1, 7))))
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, " ".join(f"s{j}" for j in range(i, i + n))) for i, n in enumerate((7, 8, 8, 7, 9, 6, 8, 10))]
    assert near(spark, rows, block=block) == brute(rows)


def test_near_duplicates_of_odd_rows(spark):
    """Repeated and null ids, ties, and a text of many words."""
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"), (None, None), (3, None), (3, "q r s t u"), (4, long), (5, long + " tail"), (5, "other words of a repeated id")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows)).collect())
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 1, None, True), (None, 0, None, True), (3, 0, 3, True), (3, 1, 3, True), (4, 70_000 * 1, 4, True), (5, None, 4, False), (5, 2, 4, False)]
    size = {4: len(shingles(long)), 5: len(shingles(long + " tail"))}
    want = sorted(((i is None, i or 0), size.get(i, n) if n is None or n > 9 else n, c, k) for i, n, c, k in want)
    assert [w[:1] + w[2:] for w in got] == [w[:1] + w[2:] for w in want] and {n for _, n, _, _ in got} == {n for _, n, _, _ in want}
    left = near_dedup.drop_near_copies(docs(spark, rows)).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 0, 0, 1, 1, 3, 3, 4] and left[0].component == 7


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.drop_near_copies(docs(spark, [])).collect() == [] and exact_dedup.drop_copies(docs(spark, [])).collect() == []

    assert near(spark, []) == {}


def test_signatures_estimate_similarity():
    import numpy as np

    from evidence_spark.llm.shingles import super_minhash

    rng, errors = np.random.default_rng(1), []
    for n in (8, 300):
        for _ in range(100):
            u = np.unique(rng.integers(0, 2**63, 4 * n)).astype(np.uint64)
            a, b = u[: 3 * n], u[n:]
            errors.append((super_minhash(np.sort(a)) == super_minhash(np.sort(b))).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < (0.25 / 128) ** 0.5


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5, 5), (None, 3)] + [(2000, 2001 + i) for i in range(50)]
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6))
    got = {r.node: r.component for r in out.collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = union_find({x for e in real for x in e}, real)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- op7 ---------------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    rng = random.Random(6)
    texts = ["a b", "a  b", "a\tb\n", " a b", "A b", None, "", " ", "x" * 50_000, "a b"] + [f"t{rng.randrange(60)} z" for _ in range(400)]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for shard in (40_000, 20):
        got = {r.doc_id: r for r in exact_dedup.dedupe(docs(spark, rows), shard=shard).collect()}
        assert len(got) == len(rows)
        for text, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    kept = exact_dedup.drop_copies(docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and sorted(r.doc_id for r in kept.collect()) == sorted(min(x) for x in groups.values())
    assert exact_dedup.dedupe(docs(spark, [])).collect() == []


def test_exact_dedup_of_null_ids(spark):
    rows = [(None, "alone"), (None, "twice"), (None, "twice"), (None, "beside"), (5, "beside"), (0, "zero"), (None, "zero"), (7, "other")] + [(i, f"t{i}") for i in range(20, 40)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    for history in (None, F.lit(True), F.lit(False), F.col("doc_id").isNull(), F.col("doc_id").isNotNull()):
        got = [tuple(r) for r in exact_dedup.dedupe(docs(spark, rows), history=history).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = exact_dedup.drop_copies(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(((i, t) for i, t in rows if i == min((j for j in groups[t] if j is not None), default=None)), key=repr)


def test_minimal_perfect_hash():
    rng = random.Random(1)
    for n in (0, 1, 2, 1000, 5000):
        digests = [rng.randbytes(32) for _ in range(n)]
        seeds, slots = exact_dedup.build(digests)
        assert sorted(slots) == list(range(n))
        if n:
            assert exact_dedup.find(seeds, n, digests).tolist() == slots
            assert all(0 <= s < n for s in exact_dedup.find(seeds, n, [rng.randbytes(32) for _ in range(100)]).tolist())


# --- op8 ---------------------------------------------------------------------------------------------------------------


def test_blocks_reach_aliases(spark):
    link = lambda to: f'<html><head><LINK href="{to}" rel="canonical"></head>'
    rows = [
        (1, "http://a.net/x?q=1#f", link("https://shop.com/de/1")), (2, "https://b.net/y", link("//A.net/x?q=1")), (3, "https://c.net/z", '<meta http-equiv="refresh" content="0; url=https://b.net/y">'),
        (4, "https://d.net/", link("/other")), (5, "https://www.example.org/en/2", link("https://a.net/x?q=1")), (6, "https://sub.example.org/es/5", None), (7, "nothing", link("https://b.net/y")), (8, None, None),
        (9, "http://SHOP.com/fr/a", "<p>"), (10, "ftp://xexample.org/es/1", ""), (11, "https://e.net/dir/page", link("twin")), (12, "https://e.net/dir/twin", ""), (13, "https://e.net", ""),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")
    moved = spark.createDataFrame([("https://e.net/dir/twin", "https://example.org/en/1z")], "url string, to string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, redirects=moved).collect()}
    assert got == {
        1: ("a.net", "/x", None, "block"), 2: ("b.net", "/y", None, "block"), 3: ("c.net", "/z", None, "block"), 4: ("d.net", "/", None, "allow"), 5: ("www.example.org", "/en/2", "org/", "allow"),
        6: ("sub.example.org", "/es/5", "example.org/es/", "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("shop.com", "/fr/a", "com/fr/", "allow"), 10: ("xexample.org", "/es/1", "org/", "allow"),
        11: ("e.net", "/dir/page", None, "block"), 12: ("e.net", "/dir/twin", None, "block"), 13: ("e.net", "", None, "allow"),
    }
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_forms_of_links(spark):
    forms = {
        "<meta http-equiv=\"refresh\" content=\"0; url='https://b.net/y'\">": "https://b.net/y", "<META content='5;URL=\"https://b.net/y\"' HTTP-EQUIV='Refresh'>": "https://b.net/y",
        "<meta http-equiv=refresh content=0;url=https://b.net/y>": "https://b.net/y", '<meta http-equiv="refresh" content="0; url=https://b.net/it\'s">': "https://b.net/it's",
        '<meta http-equiv="refresh" content="0; url=&#39;https://b.net/y?a=1&amp;b=2&#39;">': "https://b.net/y?a=1&b=2", '<meta http-equiv="refresh" content="0; url= https://b.net/y ">': "https://b.net/y",
        '<link rel="nofollow canonical" href="https://b.net/y">': "https://b.net/y", "<link href='https://b.net/y' rel='canonical alternate'>": "https://b.net/y", "<link rel=canonical href=https://b.net/y>": "https://b.net/y",
        '<link rel="canonical" href="https://b.net/?a=1&amp;b=2">': "https://b.net/?a=1&b=2", '<link rel="canonical" href="https://b.net/?a=1&copy=2&#x26;c&amp;lt;">': "https://b.net/?a=1&copy=2&c&lt;", '<link rel="canonical" href="/y?q=it\'s"/>': "https://a.net/y?q=it's",
        '<link rel="canonical-not" href="https://b.net/y">': None, '<link rel="next" href="https://b.net/canonical">': None, '<link rel="canonical" href="">': None, '<meta http-equiv="refresh" content="5">': None, '<meta http-equiv="refresh" content="0; url=">': None,
    }
    df = spark.createDataFrame([(f"https://a.net/{i}", h) for i, h in enumerate(forms)], "url string, html string")
    got = {r.url: r.to for r in url_filter.page_links(df).collect()}
    for i, (form, want) in enumerate(forms.items()):
        assert got.get(f"https://a.net/{i}") == want, form
    pages = [(1, "https://a.net/?a=1&b=2", "<meta http-equiv='refresh' content='0; url=\"https://shop.com/de/1\"'>"), (2, "https://c.net/", '<link rel="x canonical" href="https://a.net/?a=1&amp;b=2">')]
    assert [r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()] == ["block"] * 2


def test_references_are_resolved():
    """Examples of RFC 3986, section 5.4, without fragments."""
    base = "http://a/b/c/d;p?q"
    cases = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y",
        ";x": "http://a/b/c/;x", "g;x?y": "http://a/b/c/g;x?y", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g",
        "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
        "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "mailto:x@y": None, "javascript:void(0)": None, "https://h/x": "https://h/x",
    }
    assert {h: url_filter.resolve(base, h) for h in cases} == cases
    assert url_filter.resolve("http://a.net/b/c", "?x=1") == "http://a.net/b/c?x=1" and url_filter.resolve("http://a.net", "x") == "http://a.net/x"


def test_fragments_make_no_aliases(spark):
    rows = [(1, "http://a.net/b/c", '<link rel="canonical" href="#m">'), (2, "http://a.net/b/d", '<link rel="canonical" href="#m">'), (3, "http://a.net/b/e", "<meta http-equiv='refresh' content='1;url=https://x.com/de/'>"), (4, "http://q.net/", '<base href="http://a.net/b/"><link rel=canonical href="e">')]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block"}


def judged_by_hand(pages, rules):
    """Verdicts by breadth-first search over the links."""

    def split(url):
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
        return (m[2].lower(), m[3], m[4] or "") if m else ("", "", "")

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    near, out = {}, {}
    for _, url, to in pages:
        if to and split(url)[0] and split(to)[0]:
            near.setdefault(split(url), set()).add(split(to))
            near.setdefault(split(to), set()).add(split(url))
    for i, url, _ in pages:
        start = split(url)
        name, verdict = rule(*start[:2])
        if verdict is None:
            seen, todo = {start}, [start]
            while todo:
                for n in near.get(todo.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            verdict = "block" if start[0] and any(rule(*n[:2])[1] == "block" for n in seen) else "allow"
        out[i] = (start[0], start[1], name, verdict)
    return out


def linked_pages(rng, n):
    host = lambda: rng.choice(("a.net", "B.net", "c.info", "www.example.org", "shop.com", "x.shop.com", "example.org"))
    url = lambda: f"{rng.choice(('http', 'https'))}://{host()}/{rng.choice(('', 'en/', 'es/', 'de/', 'fr/', 'q/'))}{rng.randrange(30)}"
    pages = [(i, url(), url() if rng.random() < 0.35 else None) for i in range(n)]
    return pages, [(i, u, f'<p><link rel="canonical" href="{to}">' if to else "<p>") for i, u, to in pages]


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_over_random_links(spark, seed):
    pages, rows = linked_pages(random.Random(seed), 250)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert url_filter.page_links(df).count() > 50
    many = [*url_filter.RULES, ("net", "/en/1", "block"), ("net", "/en/", "allow"), ("a.net", "/q", "block"), ("c.info", "", "block"), ("c.info", "/es/2", "allow")]
    table = spark.createDataFrame(many, "host string, path string, verdict string")
    for rules, given in ((url_filter.RULES, url_filter.RULES), (many, many), (many, table), (many, [*many, *((f"h{k}.zz", "/", "block") for k in range(300))])):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, given).collect()}
        assert got == judged_by_hand(pages, rules)
    assert sum(v == "block" and r is None for _, _, r, v in got.values()) > 10


def test_the_sql_follows_links(spark, tmp_path):
    import duckdb

    _, rows = linked_pages(random.Random(3), 200)
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.sql(queries.ORACLE["op8_url_filter"])
    names = want.columns
    got = queries.op8_url_filter(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and sum(r.rule is None and r.verdict == "block" for r in got) > 5


# --- op5 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~langid.held_out()))


def test_held_out_accuracy(spark, model):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = {r.doc_id for r in table.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    out = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id for r in out if r.held_out} == fold and len(out) == table.count()
    assert sum(r.lang_pred == r.lang for r in out if r.held_out) / len(fold) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_spans_and_odd_texts(spark, model):
    en, fr = (r[0] for r in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(f"lang = '{x}' and n_chars between 400 and 3000").orderBy("doc_id").select("text").first() for x in ("en", "fr")))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, f"{en} {fr}"), (5, en), (6, "漢字 かな"), (7, "x" * 20_000), (8, en)]
    got = {r.doc_id: r for r in langid.predict(docs(spark, rows), model, spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 5)] == ["und", "und", "und", "en"]
    langs = [s.lang for s in got[4].spans]
    assert langs[0] == "en" and langs[-1] == "fr" and sum(s.words for s in got[4].spans) == len(f"{en} {fr}".split())
    assert got[5].lang_pred == got[8].lang_pred and got[5].score == got[8].score
    kept = langid.keep_identified(docs(spark, rows), model)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8] and kept.columns == docs(spark, rows).columns
    nothing = langid.fit(docs(spark, rows).where("false"))
    assert {r.lang_pred for r in langid.predict(docs(spark, rows), nothing).collect()} == {"und"}


def test_one_language_is_kept_only_where_that_is_best(model):
    """The shortcut for texts of one language gives what Viterbi gives."""
    import numpy as np

    rng = random.Random(3)
    words = "the of and le la et der die und el los que ción ment keit tion".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(200)]
    model.look_up([w for t in texts for w in t.split()])
    for text, (got, _) in zip(texts, model.labels(texts), strict=True):
        if text:
            s = model.scores[model.look_up(text.split())]
            value = lambda path, s=s: sum(s[i, k] for i, k in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))
            assert value(got.tolist()) >= value(model.label(s)) - 1e-6 and len(got) == len(s)
    assert isinstance(np.asarray(got), np.ndarray)


def test_two_languages_with_a_third_ahead():
    """Neither part gains more than SWITCH over the lead, both together do."""
    import numpy as np

    rng, flagged = random.Random(4), 0
    words = {"a": (0, -4, -1.5), "b": (-4, 0, -1.5), "c": (-3, -3, 0), "d": (-1.2, -4, 0), "e": (0, -0.5, -0.4)}
    three = langid.Model(["A", "B", "C"], np.zeros((langid.FEATURES, 3), np.float32), {})
    three.look_up(list(words))
    for w, s in words.items():
        three.scores[three.rows[w]] = s
    assert three.labels(["a " * 6 + "b " * 6])[0][0].tolist() == [0] * 6 + [1] * 6
    texts = ["a " * rng.randrange(8) + rng.choice(("", "c ", "e d ")) + "b " * rng.randrange(8) + "a " * rng.randrange(8) for _ in range(300)]
    texts += [" ".join(rng.choices("abcde", (3, 3, 2, 1, 1), k=rng.randrange(1, 25))) for _ in range(300)]
    for text, (got, _) in zip(texts, three.labels(texts), strict=True):
        if text.strip():
            s = three.scores[three.look_up(text.split())]
            value = lambda path, s=s: sum(s[i, k] for i, k in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))
            best = three.label(s)
            flagged += 2 in s.sum(axis=0).argsort()[-1:] and len(set(best)) > 1
            assert value(got.tolist()) >= value(best) - 1e-6
    assert flagged > 10


def test_every_sign_of_a_long_word_counts(spark, model):
    en, fr = (re.sub(r"\W+", "", spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(f"lang = '{x}' and n_chars > 3000").orderBy("doc_id").select("text").first()[0]) for x in ("en", "fr"))
    mixed = "Smith" + "说这是一个很长的句子" * 30
    rows = [(1, en[:40] + fr[:2000]), (2, f"a {en[:40]}{fr[:2000]} b")]
    got = {r.doc_id: r for r in langid.predict(docs(spark, rows), model, spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2)] == ["fr", "fr"]
    assert all(s.first + s.words <= 3 for s in got[2].spans) and got[2].spans[-1].first + got[2].spans[-1].words == 3
    taught = [(1, "the of and to in that it is was for " * 20, "en"), (2, "说这是一个很长的句子我们没有空格" * 20, "zh")]
    small = langid.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.predict(docs(spark, [(1, mixed), (2, "说这是" + "theofandto" * 30)]), small, spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2)] == ["zh", "en"]
    assert [(s.first, s.words, s.lang) for s in got[1].spans] == [(0, 1, "en"), (0, 1, "zh")] and got[1].score == 300 / 305
    for word in (mixed, "x" * 81, "12345" * 20 + "Ж" + "漢字かな", "é", "naïve-Жa", ""):
        pieces = langid.pieces_of(word)
        assert "".join(pieces) == word and all(len(p) <= 40 and len({langid.script_of(c) for c in p if c.isalpha()}) <= 1 for p in pieces)


def labelled_by_hand(model, text):
    """(language, score) from the definition, in plain Python: features hashed one by one, Viterbi over every piece and language."""
    import math

    import numpy as np

    def mixed(x):
        m = (1 << 64) - 1
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return x ^ x >> 31

    def scores(piece):
        low = piece.lower()
        letters = [c for c in low if c.isalpha()]
        script = langid.script_of(letters[0]) if letters else ""
        if script not in model.scripts:
            return [0.0] * len(model.languages), len(letters)
        marked, found = f"<{low}>", [zlib.crc32(f"<{low}>".encode()) % langid.FEATURES]
        for n in (2, 3, 4):
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) & (1 << 64) - 1
                found.append(mixed(h) % langid.FEATURES)
        ks = model.scripts[script]
        raw = {k: sum(float(model.weights[f, k]) for f in found) / len(found) * min(4.0, 1 + 0.5 * len(letters)) for k in ks}
        top = max(raw.values())
        return [max(raw[k] - top, -8.0) if k in raw else -langid.EXCLUDED for k in range(len(model.languages))], len(letters)

    rows = [scores(p) for w in (text or "").split() for p in langid.pieces_of(w)]
    if not sum(n for _, n in rows):
        return "und", 0.0
    best, back = list(rows[0][0]), []
    for s, _ in rows[1:]:
        step = [max(range(len(best)), key=lambda j, k=k: (best[j] - langid.SWITCH * (j != k), j == k, -j)) for k in range(len(best))]
        back.append(step)
        best = [best[j] - langid.SWITCH * (j != k) + s[k] for k, j in enumerate(step)]
    path = [max(range(len(best)), key=lambda k: (best[k], -k))]
    for step in reversed(back):
        path.append(step[path[-1]])
    by = np.bincount(path[::-1], [n for _, n in rows], len(best))
    assert math.isclose(by.sum(), sum(n for _, n in rows))
    return model.languages[int(by.argmax())], float(by.max() / by.sum())


def test_predictions_equal_the_definition(spark, model):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = {x: [r.text.split()[:300] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(f"lang = '{x}' and n_chars > 2000").orderBy("doc_id").limit(2).collect()] for x in model.languages}
    rng, mixed = random.Random(8), []
    for i in range(120):
        parts = []
        for x in rng.sample(model.languages, rng.randrange(1, 4)):
            source, n = rng.choice(words[x]), rng.randrange(1, 25)
            at = rng.randrange(len(source) - n)
            parts.append(("" if rng.random() < 0.2 else " ").join(source[at : at + n]))
        mixed.append((10_000 + i, " ".join(parts)))
    rows = table + mixed + [(1, "é"), (2, "12 34"), (3, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, mixed + [(1, "é"), (2, "12 34"), (3, None)]), model).collect()}
    want = {i: labelled_by_hand(model, t) for i, t in rows[len(table) :]}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()} and all(got[i][1] == pytest.approx(want[i][1]) for i in want)
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, table[:60]), model).collect()}
    assert all(whole[i][0] == labelled_by_hand(model, t)[0] and whole[i][1] == pytest.approx(labelled_by_hand(model, t)[1]) for i, t in table[:60])


def test_scripts_narrow_the_candidates(spark):
    """A text of several scripts, where a language that shares no script with a word is never its label."""
    taught = [(1, "the of and to in that it is was for " * 20, "en"), (2, "и в не на что он как это по но " * 20, "ru"), (3, "і в не на що він як це по але " * 20, "uk"), (4, "και το να η δεν που με για από τα " * 20, "el")]
    m = langid.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    assert m.scripts == {"Latin": [m.languages.index("en")], "Greek": [m.languages.index("el")], "Cyrillic": sorted(map(m.languages.index, ("ru", "uk")))}
    rng = random.Random(2)
    rows = [(i, " ".join(" ".join(rng.choices(rng.choice(taught)[1].split(), k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5)))) for i in range(80)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, rows), m).collect()}
    assert all(got[i][0] == (w := labelled_by_hand(m, t))[0] and got[i][1] == pytest.approx(w[1]) for i, t in rows)


def test_predictions_of_repeated_rows_and_empty_tables(spark, model):
    rows = [(1, "the of and"), (1, "the of and"), (None, "the of and"), (2, "der die und")]
    got = langid.predict(docs(spark, rows), model).collect()
    assert len(got) == 4 and len({(r.lang_pred, r.score) for r in got if r.doc_id != 2}) == 1
    assert langid.predict(docs(spark, []), model).collect() == [] and langid.keep_identified(docs(spark, []), model).collect() == []
    tie = langid.Model(["A", "B"], __import__("numpy").zeros((langid.FEATURES, 2), "float32"), {"Latin": [0, 1]})
    assert langid.predict(docs(spark, [(1, "any word")]), tie).first().lang_pred == "A"


# --- the whole -----------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    near_groups = brute(list(first.values()))
    want = {i for i, (_, _, kept) in near_groups.items() if kept}
    frame, previous = table, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame, previous = stage(spark, frame, SF), frame
        assert frame.columns == table.columns, name
    assert {r.doc_id for r in frame.collect()} == want
    out = corpus_pipeline.run(spark, SF)
    total = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in total} == want and all(r.n == r.m for r in total)


COLUMNS = {
    "op1_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_piece_sampling": "doc_id ids", "op5_language_id": "doc_id held_out lang_pred score spans", "op6_near_dedup": "doc_id n_shingles component_id kept", "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_url_filter": "page_id host path rule verdict", "op9_token_store": "doc_id start n_tokens ids_crc32", "op10_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature rgb",
    "op11_source_divergence": "lang source part item value rank", "op12_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op13_importance_resampling": "doc_id n_features weight score rank",
}


def test_clashing_columns_pass_through(spark):
    """Columns with the names that the filtering stages use, or might use, themselves."""
    import corpus_pipeline

    extra = ["_id", "_text", "_gone", "gone", "Gone_text", "key", "digest", "kept", "rep", "node"]
    text = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"
    rows = [(1, text), (1, text), (2, text.replace(" ", "  ")), (3, text + " dreizehn"), (None, text), (None, "anders ist dieser Text"), (None, "anders  ist dieser Text"), (5, "ganz anders")]
    df = spark.createDataFrame([(i, t, "de", *extra) for i, t in rows], ["doc_id", "text", "lang", *extra])
    exact = exact_dedup.drop_copies(df)
    # The rows without an id: one repeats a text that has one and goes, the two alike without one stay together.
    assert exact.columns == df.columns and sorted((r.doc_id or 0) for r in exact.collect()) == [0, 0, 1, 1, 3, 5]
    near = near_dedup.drop_near_copies(df)
    assert near.columns == df.columns and {r.doc_id for r in near.collect()} == {1, 5, None}
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == df.columns
    assert {r.doc_id for r in docs.collect()} == {1, 5, None}
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == {1, 5, None}


@pytest.mark.parametrize("name", COLUMNS)
def test_every_query_has_its_columns_and_rows(spark, name):
    assert list(COLUMNS) == [n for n in queries.QUERIES if n.startswith("op")]
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    keys = got.select(got.columns[0]).collect()
    known = spark.read.parquet(f"{SF}/{'conversations' if name.startswith('op1_') else 'pages' if name.startswith('op8') else 'documents'}.parquet")
    want = {r[0] for r in known.select(got.columns[0]).collect()} | ({-7} if name.startswith("op1_") else set())
    assert {r[0] for r in keys} == want
    if name.startswith(("op3", "op5", "op6", "op7", "op8", "op9", "op10", "op12", "op13")):
        assert len(keys) == known.count()


def test_the_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    text = "Eins zwei drei vier fünf sechs sieben acht neun zehn elf"
    odd = [(None, text, None, None, None), (1, text, "de", "s", 1), (2, text.replace(" ", "\n"), None, "s", 1), (2, text + " zwölf", "de", None, 2), (3, None, None, None, None), (4, "", "de", "s", 0), (5, "42", "de", "s", 2)]
    for k, rows in enumerate((odd, [])):
        spark.createDataFrame(rows, table.schema).coalesce(1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/0").collect()
    assert {r.doc_id for r in out} == {1}
    assert corpus_pipeline.run(spark, f"{tmp_path}/1").collect() == []
