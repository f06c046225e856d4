"""Packing, classifiers, mixing, URL filter and archives."""

import collections
import hashlib
import html.parser
import io
import random
import re
import struct
import urllib.parse
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import language_id, mixing, packing, quality, queries, toxicity, url_filter, warc_zip
from evidentia.llm.textarrays import shingles, word_hashes

ODD_TEXTS = [None, "", " ", "a", "  two  spaces \n\n and\ttabs ", "it's we'll 12345 x_y", "日本語 und Ünïcode　wide", "<|endoftext|> is text", "\x1c\x85 odd", "don't  stop"]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from evidentia.llm import textarrays

    text = " ".join(f"Word{i % 97}\n" for i in range(500))
    whole = word_hashes(text), shingles(text, 3)
    monkeypatch.setattr(textarrays, "BLOCK", 64)
    assert (word_hashes(text) == whole[0]).all() and (shingles(text, 3) == whole[1]).all()
    assert len(word_hashes(text)) == 500 and (word_hashes("A b") == word_hashes("a B")).all() and len(word_hashes("a b")) == 1


def test_tokens_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(2)
    texts = [x for x in ODD_TEXTS if x is not None] + ["".join(random.choice(" \n\t.,'abcÉ1-日") for _ in range(200)) for _ in range(200)]
    for x in texts:
        assert packing.tokenizer(None).ids(x).tolist() == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("max_open", [2048, 4])
def test_packing_is_a_round_trip(spark, max_open):
    random.seed(1)
    texts = ODD_TEXTS + [" ".join(random.choice(["alpha", "beta", "gamma"]) for _ in range(random.choice([3, 700, 2047, 9000]))) for _ in range(60)]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, ids_le string")
    got = packing.pack(df.coalesce(2), max_open=max_open).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t, *_ in rows:
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids_le"], "<u4") for r in pieces])
        assert ids.tolist() == [*packing.tokenizer(None).ids(t or "").tolist(), 1]
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist() and {r["doc_tokens"] for r in pieces} == {len(ids)}
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        used = sum(r["length"] for r in pieces)
        assert [r["offset"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist() and used <= 2048
        padding += {r["sequence_length"] for r in pieces}.pop() - used
    assert padding == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_sum_of_squares_rule():
    p = packing.SumOfSquares(10)
    random.seed(3)
    for _ in range(300):
        size = random.randint(1, 9)
        counts = p.level.copy()

        def cost(level, size=size, counts=counts):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 10:
                c[level + size] += 1
            return int((c**2).sum())

        levels = [h for h in range(10 - size + 1) if h == 0 or counts[h]]
        assert cost(p.place(size)) == min(map(cost, levels))
        list(p.add(0, size, np.zeros(size, np.uint32)))


def slow_sequences(sizes, c, grain):
    """The rule tried out: every open window's level and a new window are costed by counting all levels anew."""
    windows, spare, waiting, done = [], [0, 0], [], []
    level = lambda fill: -(-fill // grain)

    def squares(fills):
        return sum(n * n for n in collections.Counter(map(level, fills)).values())

    def complete(w):
        take = min(c - sum(w), spare[0])
        if take:
            spare[0] -= take
            w.append(take)
        (done if sum(w) == c else waiting).append(w)

    for size in sizes:
        if waiting:
            spare[0] = size
            for w in [waiting.pop(0) for _ in range(len(waiting))]:
                complete(w)
            continue
        choices = {}
        for w in [[], *windows]:
            fill = sum(w)
            if level(fill) not in choices and (not w or fill == next(sum(x) for x in windows if level(sum(x)) == level(fill))) and fill + size <= c:
                others = [sum(x) for x in windows if x is not w]
                choices[level(fill)] = (squares(others + ([] if c - fill - size < grain else [fill + size])), not w, -level(fill), w)
        w = min(choices.values(), key=lambda x: x[:3])[3]
        windows = [x for x in windows if x is not w]
        w = [*w, size]
        if c - sum(w) < grain:
            complete(w)
        else:
            windows.append(w)
    return done, windows


@pytest.mark.parametrize(("c", "grain"), [(30, 1), (40, 8), (64, 16)])
def test_sequences_are_those_of_a_slow_packer(c, grain):
    random.seed(c)
    sizes = [random.randint(1, c - 1) for _ in range(400)]
    p, got = packing.SumOfSquares(c, grain=grain), []
    for i, n in enumerate(sizes):
        got += [[len(x[3]) for x in pieces] for pieces, _ in p.add(i, n, np.arange(n, dtype=np.uint32))]
    done, windows = slow_sequences(sizes, c, grain)
    assert got == done
    assert sorted([len(x[3]) for x in w] for at in p.at for _, w in at) == sorted(windows)


def test_most_sequences_come_from_placements_in_small_tasks():
    random.seed(8)
    p, placed, later = packing.SumOfSquares(2048, grain=packing.GRAIN), 0, 0
    for i in range(300):
        n = 1 + int(random.expovariate(1 / 700)) % 2047  # about the sizes of the test documents
        placed += len(list(p.add(i, n, np.zeros(n, np.uint32))))
    later = list(p.close())
    assert placed >= 0.9 * (placed + len(later)) and p.kept >= 0.9 * (p.kept + p.moved)
    # completed at the end: full ones first, then powers of two
    assert all(sum(len(x[3]) for x in pieces) == padded for pieces, padded in later) and [n for _, n in later if n < 2048] == sorted((n for _, n in later if n < 2048), reverse=True)


def sentences(words, n, seed):
    random.seed(seed)
    return [" ".join(random.choice(words) for _ in range(random.randint(5, 60))) for _ in range(n)]


def test_language(spark):
    en, de = sentences("the house and that water with thing".split(), 150, 1), sentences("das haus und dass wasser mit schön".split(), 100, 2)
    rows = [(i, t, "en" if t in en else "de", "x") for i, t in enumerate(en + de)] + [(900 + i, t, None, "x") for i, t in enumerate([None, "", "123 !!", "das wasser und haus " * 3000])] + [(None, "the water", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language_id.train(df, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert len(got) == len(rows) and all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows if lang)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and got[900]["score"] == 0 and got[903]["score"] > 0.9
    assert (np.abs(model.weights) > 0).mean() < 0.2  # elastic net
    nothing = language_id.train(df.limit(0), F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(df, nothing).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_binary_classifiers(spark, module):
    plain = sentences("calm words about weather and gardens in spring".split(), 200, 3)
    marked = [t + (" you wretched scoundrel" if module is toxicity else " ### $$$ ###") for t in sentences("calm words about weather and gardens in spring".split(), 100, 4)]
    rows = [(i, t, "s") for i, t in enumerate(plain + marked)] + [(800, None, "s"), (801, "", "s"), (802, "calm weather " * 20_000, "s"), (None, "calm", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    label = "toxic" if module is toxicity else "quality"
    y = lambda i: int(i >= 200)
    labels = spark.createDataFrame([(i, y(i)) for i in range(300)] + [(5, 0), (6, 1), (800, 0), (None, 1), (7777, 1), (9, None)], f"doc_id long, {label} int")
    model = module.train(df, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in module.score(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(0, 300, 5)]
    assert np.mean([(got[i] >= 0.5) == y(i) for i in held]) > 0.97
    empty = module.train(df, labels.limit(0), F.lit(True))
    assert len({round(r["score"], 12) for r in module.score(df, empty).collect()}) == 1
    assert module.score(df.limit(0), model).count() == 0


def water_fill(budget, children):
    """children: name -> (capacity, weight)."""
    out, left = {}, dict(children)
    while left:
        w = sum(x[1] for x in left.values())
        full = [n for n, (c, k) in left.items() if c * w <= k * budget]
        if not full:
            upto = 0
            for n in sorted(left, key=lambda n: hashlib.md5(n.encode()).hexdigest()):
                k = left[n][1]
                out[n], upto = (upto + k) * budget // w - upto * budget // w, upto + k
            return out
        n = min(full, key=lambda n: (left[n][0] / left[n][1], n))
        out[n], budget = left[n][0], budget - left[n][0]
        del left[n]
    return out


def test_mixing(spark):
    random.seed(6)
    rows = [(i, " ".join(["w"] * random.randint(0, 30)), random.choice(["en", "de", None]), random.choice(["big"] * 6 + ["a", "b"]), 1) for i in range(400)] + [(400, None, "en", "a", 1), (None, "w w", "en", "a", 1), (3, "w w w", "de", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch long")
    weights = {("en",): 5, ("de",): 1, ("(null)",): 1, ("en", "big"): 1, ("en", "a"): 9, ("de", "b"): 0}
    got = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, weights, 0.7, 2, 1).collect()
    n = lambda t: len((t or "").split())
    avail = collections.Counter()
    for i, t, lang, s, _ in rows:
        if i is not None and n(t):
            avail[lang or "(null)", s] += n(t)
    use = {k: v for k, v in avail.items() if weights.get(k, 1)}
    cap = collections.Counter()
    for (lang, _), v in use.items():
        cap[lang] += 2 * v
    top = water_fill(int(0.7 * sum(avail.values())), {k: (v, weights.get((k,), 1)) for k, v in {lang: 2 * sum(v for (x, _), v in avail.items() if x == lang) for lang in {k[0] for k in avail}}.items()})
    expected = {}
    for lang, b in top.items():
        for s, v in water_fill(b, {s: (2 * v, weights.get((lang, s), 1)) for (x, s), v in use.items() if x == lang}).items():
            expected[lang, s] = v
    taken = collections.Counter()
    for r in got:
        taken[r["lang"], r["source"]] += r["taken"]
        assert 0 < r["taken"] <= r["doc_tokens"] and r["epoch"] < 2
    assert dict(taken) == {k: v for k, v in expected.items() if v}
    assert sum(taken.values()) == int(0.7 * sum(avail.values())), "nothing of the budget is lost to rounding"
    odd = mixing.mix(df, {"weight": F.col("lang"), "tokens": F.col("source")}, weights, 0.7, 2, 1)
    assert odd.columns == ["doc_id", "weight", "tokens", "epoch", "doc_tokens", "taken"] and sorted(map(tuple, odd.collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(df.limit(0), {"lang": F.col("lang")}, {}, 0.5).count() == 0


def test_url_filter(spark):
    page = lambda to: f'<html><head><link href="{to}" rel="canonical"></head>'
    rows = [
        (1, "http://A.Example.NET/x", "", 0), (2, "http://example.net/en/a?x#y", "", 0), (3, "https://de.example.com/de/1", "", 0), (4, "https://example.com/en/1", page("https://example.com/de/2"), 0),
        (5, "http://x.org/fr/", "", 0), (6, "http://x.org/xx", page("http://example.com/en/1"), 0), (7, None, None, 0), (8, "nothing", "", 0), (9, "http://myexample.com/de/", "", 0), (10, "http://net", None, 0),
        (11, "http://y.org/q", '<meta http-equiv="refresh" content="0; url=https://example.com/en/1#frag">', 0), (12, "http://example.net/en/b", page("http://bad.net/z"), 0), (13, "https://EXAMPLE.com/en/1#top", "", 0), (13, "https://EXAMPLE.com/en/1#top", "", 0),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    rules = [url_filter.parse_rule(x) for x in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(df, rules).collect()}
    assert got[1] == ("a.example.net", "/x", "net/", "block") and got[2] == ("example.net", "/en/a", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6][3] == "allow" and got[7] == got[8] == ("", "", None, "allow") and got[9][2:] == (None, "allow") and got[10] == ("net", "", None, "allow")
    assert got[11][2:] == (None, "block") and got[12][2:] == ("example.net/en/", "allow") and got[13][2:] == (None, "block")
    assert url_filter.judge(df, rules).count() == len(rows) and url_filter.judge(df.limit(0), rules).count() == 0
    links = spark.createDataFrame([("http://x.org/xx", "http://q.net/"), (None, "http://q.net/")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules, links).collect()}[6] == "block"


class Links(html.parser.HTMLParser):
    """Where a page leads, by other means than the operator's."""

    def __init__(self, url, page):
        super().__init__()
        self.url, self.base, self.found = url, None, []
        self.feed(page)
        self.close()
        base = urllib.parse.urljoin(url, self.base) if self.base else url
        self.found = [urllib.parse.urljoin(base, t) for t in self.found if t and not t.startswith("#") and not re.match("(?i)(mailto|javascript):", t)]

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "").strip() for k, v in reversed(attrs)}
        if tag == "base" and self.base is None and a.get("href"):
            self.base = a["href"]
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            self.found.append(a.get("content", "").lower().partition("url=")[2].strip().strip("'\""))

    handle_startendtag = handle_starttag


def test_links_are_those_of_a_parser(spark, tmp_path):
    link = lambda to, rel="canonical": f'<link rel="{rel}" href="{to}">'
    pages = [
        link("/go?u=http://evil.net/"), link("http://good.org/z?a=1&amp;b=2"), link("c.html"), link("../x"), link("?p=2"), link("./a/../../b/./c/"), link("//other.org/q"), link("#top"), link(""), link("mailto:a@b.c"),
        link("/x", "alternate canonical"), link("/x", "CANONICAL nofollow"), link("/x", "noncanonical"), '<link data-x="a > b" rel=canonical href=/unquoted/y>', "<link href='/single' rel='canonical' />",
        "<!-- " + link("/hidden") + " -->" + link("/shown"), "<script>var a = '" + link("/scripted") + "'</script>", '<base href="/deep/er/">' + link("x"), '<base href="https://cdn.org/a/b">' + link("../up"),
        '<meta content="0; url=next" http-equiv="Refresh">', '<META HTTP-EQUIV=refresh CONTENT="5;URL=\'/quoted\'">', '<meta http-equiv="refresh" content="30">', '<meta name="x" content="url=/no">', '<link title=\'rel="canonical"\' href="/no">', link("..") + link("a/.."), "<link rel=canonical>", "",
    ]
    rows = [(f"{url}?n={i}" if q else url.replace("N", str(i)), page) for url, q in (("http://good.org/d/e/a.html", True), ("http://good.org", True), ("https://S.good.org/N/", False)) for i, page in enumerate(pages)]
    got = collections.defaultdict(set)
    for r in url_filter.html_links(spark.createDataFrame([*rows, (None, pages[0]), ("http://a.b/", None)], "url string, html string")).collect():
        got[r["source"]].add(r["target"])
    for url, page in rows:
        assert got[url] == set(Links(url, page).found), (url, page)
    # the query's SQL reads the same links, and so gives the same verdicts
    hosts = [(f"http://good.org/{x}", "") for x in ("z?a=1&b=2", "d/x", "d/e/c.html", "x", "deep/er/x")] + [("http://bad.net/", link("http://good.org/x")), ("http://other.net/", link("http://good.org/d/e/c.html"))]
    table = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate([*rows, *hosts, (None, None)])], "page_id long, url string, html string")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        expected = db.execute(queries.SQL["op1_url_filter"]).fetchall()
    found = [tuple(r) for r in queries.op1_url_filter(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str) and sum(r[4] == "block" for r in found) >= 10


def test_links_carry_blocks(spark):
    page = lambda to: f'<link rel="canonical" href="{to}">'
    rows = [(1, "http://good.org/a", page("/go?u=http://evil.net/")), (2, "http://sub.net/x", page("http://good.org/z?a=1&amp;b=2")), (3, "http://good.org/z?a=1&b=2", ""), (4, "http://x.org/d/p", page("../q")), (5, "http://x.org/q", page("//c.net/")), (6, "http://x.org/free", page("?"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, [url_filter.parse_rule("block net/")]).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_archives_are_a_round_trip(spark, tmp_path):
    long, other = "long page é " * 200, "other " * 5000
    rows = [(1, "http://a/1", long, "x"), (5, "http://a/5", long, "x"), (3, None, long, "x"), (2, "http://a/2", "short", "x"), (4, "http://a/4", "short", "x"), (6, "http://\r\nodd", None, "x"), (7, "u", "", "x"), (None, "u", long, "x"), (8, "u8", other, "x"), (8, "u8", other, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    archives = warc_zip.write_archives(df, folder=tmp_path.as_uri())
    got = warc_zip.read_archives(archives).collect()
    kinds = sorted(((r["key"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert kinds == sorted([(1, "revisit", 5), (5, "response", None), (3, "revisit", 5), (2, "response", None), (4, "response", None), (6, "response", None), (7, "response", None), (None, "revisit", 5), (8, "response", None), (8, "response", None)], key=str)
    text = {i: t for i, _, t, _ in rows}
    for r in got:
        assert r["payload_bytes"] == len((text[r["key"]] or "").encode())
        if r["record_type"] == "response":
            assert r["payload"].decode() == (text[r["key"]] or "")
    for p in tmp_path.glob("*.zip"):  # other readers can read them
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert warc_zip.read_archives(warc_zip.write_archives(df.limit(0))).count() == 0


def test_reader_knows_zip64():
    data, name, body = io.BytesIO(), b"archive/a", b"hello"
    data.write(b"PK\x03\x04" + bytes(22) + struct.pack("<HH", len(name), 0) + name + body)
    start = data.tell()
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    data.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
    end = data.tell()
    data.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, end - start, start))
    data.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    raw = data.getvalue()
    r = warc_zip.ArchiveReader(lambda at, n: raw[at : at + n], len(raw))
    assert raw[slice(*(lambda p: (p[0], sum(p)))(r.place("archive/a")))] == body
