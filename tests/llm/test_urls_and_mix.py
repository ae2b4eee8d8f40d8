"""The URL filter against a brute-force model, and the mix against its SQL."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from pyspark.sql import functions as F

from modelwatch.llm import mixing, url_filter
from modelwatch.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:stop]


def rule_of(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def spelled(url):
    """What the models see: host in lower case and all that follows; the whole string without ``://``."""
    url = url or ""
    host = parts(url)[0]
    return host + url.split("://", 1)[1][len(host):] if "://" in url else url


def held_out(u):
    h = xxhash.xxh64_intdigest(u.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % url_filter.HELD_OUT == 0


def brute_scores(urls):
    """Mean log ratio of each spelled URL by two Witten-Bell models of order 4, and the cut."""
    grams = lambda u: [("\x01" * 4 + u + "\x02")[i:i + 5] for i in range(len(u) + 1)]
    counts = {side: [Counter() for _ in range(5)] for side in ("allow", "block")}
    follow = {side: [defaultdict(Counter) for _ in range(5)] for side in ("allow", "block")}
    for url in urls:
        side, u = rule_of(*parts(url))[1], spelled(url)
        for g in grams(u) if side and not held_out(u) else []:
            for k in range(5):
                counts[side][k][g[4 - k:]] += 1
                follow[side][k][g[4 - k:4]][g[4]] += 1

    def p(side, g):
        out = 1 / 257
        for k in range(5):
            after = follow[side][k].get(g[4 - k:4])
            if after:
                kinds = len(after)
                out = (counts[side][k][g[4 - k:]] + kinds * out) / (sum(after.values()) + kinds)
        return out

    known = {g: math.log(p("allow", g)) - math.log(p("block", g)) for g in {g for u in map(spelled, urls) for g in grams(u)}}
    scores = {u: sum(known[g] for g in grams(u)) / (len(u) + 1) for u in set(map(spelled, urls))}
    sides = {v: [scores[spelled(u)] for u in urls if rule_of(*parts(u))[1] == v and held_out(spelled(u))] for v in ("allow", "block")}
    if not all(sides.values()):
        sides = {v: [scores[spelled(u)] for u in urls if rule_of(*parts(u))[1] == v] for v in ("allow", "block")}
    if not all(sides.values()):
        return scores, 0.0
    (ma, da), (mb, db) = ((sum(x) / len(x), math.sqrt(max(0, sum(y * y for y in x) / len(x) - (sum(x) / len(x)) ** 2)) + 1e-6) for x in (sides["allow"], sides["block"]))
    return scores, (ma * db + mb * da) / (da + db)


@pytest.mark.parametrize("odd_rows", [False, True])
def test_op5(work, tmp_path, odd_rows):
    folder, pages = SF, duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    if odd_rows:
        pages = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.NET/en/x?q=/de/#f"), (5, "http://example.net?x"), (6, "http://xnet/"),
                 (7, "http://a.b.org/fr/" + "z" * 20_000), (8, "://é.org/fr/é"), (9, "http://é.com/fr/"), (None, None), (4, "HTTP://A.Example.NET/en/x?q=/de/#f")]
        folder = str(tmp_path)
        work.createDataFrame(pages, "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    rows = QUERIES["op5_url_filter"](work, folder).collect()
    scores, cut = brute_scores([u for _, u in pages])
    urls = {i: spelled(u) for i, u in pages}
    want = Counter((i, *parts(u), rule_of(*parts(u))[0]) for i, u in pages)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == want
    assert all(abs(r.score - scores[urls[r.page_id]]) < 1e-6 for r in rows)
    assert all(r.verdict == rule_of(r.host, r.path)[1] for r in rows if r.rule)
    assert all(r.verdict == ("allow" if r.score >= cut else "block") for r in rows if not r.rule and abs(r.score - cut) > 1e-6)
    assert odd_rows or len({r.verdict for r in rows if not r.rule}) == 2


def test_no_urls(work, tmp_path):
    frame = work.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(frame).count() == 0


def test_op7_is_its_sql(work):
    got = sorted(tuple(r) for r in QUERIES["op7_mix_sources"](work, SF).select("doc_id", "leaf", "n_tokens", "copies").collect())
    duckdb.sql(f"create or replace view documents as from '{SF}/documents.parquet'")
    assert got == sorted(duckdb.sql(ORACLE_SQL["op7_mix_sources"]).fetchall()) and got


def test_level_values_with_slashes(work, tmp_path):
    """Leaves that would be spelled alike stay apart: each row comes once, and SQL agrees."""
    values = ["a/b", "a", "b", "/", "", "~", None, "%2F", "b/c", "c", "http://x/y"]
    rows = [(k, f"w{k} " * (k % 7), values[k % 11], values[k * 5 % 11]) for k in range(330)]
    frame = work.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op7_mix_sources"](work, str(tmp_path)).select("doc_id", "leaf", "n_tokens", "copies").collect()]
    assert len({r[0] for r in got}) == len(got)
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(ORACLE_SQL["op7_mix_sources"]).fetchall())
    everything = mixing.mixed(frame.select(mixing.domain().alias("domain"), "lang", "source", F.col("doc_id").alias("key"), F.md5("text").alias("text_key"),
                                           mixing.tokens().alias("n_tokens")), mixing.LEVELS, (1, 1), 1, 3)
    assert sorted(r.key for r in everything.where("copies > 0 or n_tokens = 0").collect()) == list(range(330))
