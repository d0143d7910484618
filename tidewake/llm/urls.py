"""URL filter: rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (a
parameter), by plain gradient steps; its weights become whole numbers, so that
Spark and any SQL engine score alike.  Judging is one projection of built-in
functions: no Python runs on the executors and nothing is shuffled.

Defined results: a null URL, or one without ``://``, has empty host and path,
fits no rule and gets the method's verdict on no n-grams; empty hosts and paths
likewise; very long URLs are read whole; repeated rows stay; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams (a prime), their lengths, the hash's base, and weights a unit.
BUCKETS, LENGTHS, BASE, UNIT = 16381, (3, 4), 131, 10_000
#: The intercept: log-odds of a URL none of whose n-grams was seen; it stays fixed, few URLs are to be blocked.
PRIOR = -2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the production query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_BAD_HOSTS = """
casino-win.example.org best-casino.example.net royalcasino.example.com casino777.example.org free-bets.example.com
bets-online.example.net sports-bet.example.org poker-bonus.example.net online-poker.example.com slots-jackpot.example.org
cheap-pills.example.com pills-shop.example.net buy-pills.example.org viagra-store.example.com cheap-meds.example.net
ads-track.example.com track-ads.example.net adserver.example.org click-ads.example.com popup-ads.example.net
spam-farm.example.com link-farm.example.net spam-links.example.org seo-spam.example.com content-farm.example.net
adult-x.example.net adult-video.example.com xxx-video.example.org porn-tube.example.com sex-cams.example.net
payday-loan.example.com fast-loans.example.net win-prize.example.org free-prize.example.com lottery-win.example.net
warez-crack.example.org torrent-crack.example.net keygen-warez.example.com escort-adult.example.net nude-adult.example.com
"""
_GOOD_HOSTS = """
news.example.com docs.example.org www.library.example.net museum.example.org blog.weather.example.com university.example.org
recipes.example.net garden.example.com history.example.org science.example.net travel.example.com music.example.org
m.station.example.net city.example.com school.example.org health.example.net research.example.com journal.example.org
www.mountain.example.com blog.river.example.net wiki.example.org forum.example.com support.example.net develop.example.org
shop.example.com hotel.example.net bakery.example.org theatre.example.com cinema.example.net football.example.org
m.northern.example.org www.another.example.net blog.theory.example.com thanks.example.org further.example.net southern.example.com
interest.example.net whether.example.org brother.example.com gathering.example.net question.example.org nation.example.com
station.example.org entire.example.net therapy.example.com leather.example.org nothing.example.net others.example.com
"""
_BAD_PATHS = "/casino/bonus /free-bets/ /cheap/pills.html /xxx/video /adult/ /win/prize /track/click /poker/online"
_GOOD_PATHS = "/en/4021 /fr/118.html /de/77/ /es/5 / /news/2021/05/item.html /about /docs/intro /en/99.html /blog/post-12"

#: The small labelled URL table: (url, 1 if it is to be blocked).
LABELLED = tuple(
    [(f"http://{h}/{('en', 'fr', 'de', 'es')[i % 4]}/{101 * i + 7}{('', '.html', '/')[i % 3]}", y) for y, hosts in ((1, _BAD_HOSTS), (0, _GOOD_HOSTS)) for i, h in enumerate(hosts.split())]
    + [(f"https://www.site{i}.example.org{p}", y) for y, paths in ((1, _BAD_PATHS), (0, _GOOD_PATHS)) for i, p in enumerate(paths.split())]
)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path as the filter reads them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), path[:stop]


def grams(host: str, path: str) -> list[int]:
    """Buckets of the n-grams; the part and the length salt them."""
    out = []
    for salt, text in enumerate((host, path)):
        codes = [ord(c) for c in text]
        for n in LENGTHS:
            for i in range(len(codes) - n + 1):
                h = 10 * n + salt
                for c in codes[i : i + n]:
                    h = (h * BASE + c) % 1_000_000_007
                out.append(h % BUCKETS)
    return out


@lru_cache(maxsize=4)
def train(labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = 150, rate: float = 0.5, penalty: float = 1e-4) -> tuple[int, tuple[int, ...]]:
    """Whole-number intercept and weights; a score over 0 means block."""
    rows = [(grams(*parts(u)), y) for u, y in labelled]
    w, b = [0.0] * BUCKETS, PRIOR
    for step in range(rounds):
        r = rate / (1 + step / 50)
        for x, y in rows:
            z = b + sum(w[i] for i in x) / math.sqrt(len(x) or 1)
            g = r * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for i in x:
                w[i] += g / math.sqrt(len(x)) - penalty * w[i]
    # A text's score is b * sqrt(n) + sum of weights, of the sign of z.
    return round(b * UNIT), tuple(round(v * UNIT) for v in w)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what) -> Column:
    """``what(verdict, host, path)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(what(verdict, h, p))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the method's ``score`` (over 0: block)."""
    bias, weights = train(labelled)
    table = "cast(split('" + ",".join(map(str, weights)) + "', ',') as array<bigint>)"
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    total = []
    for salt, part in enumerate(("host", "path")):
        codes = f"transform(sequence(1, length({part})), i -> cast(ascii(substring({part}, i, 1)) as bigint))"
        for n in LENGTHS:
            h = str(10 * n + salt) + "L"
            for k in range(n):
                h = f"(({h} * {BASE} + c[i + {k}]) % 1000000007)"
            # The outer transform binds a text's codes to a name, once.
            total.append(f"if(length({part}) >= {n}, aggregate(transform(array({codes}), c -> aggregate(sequence(0, size(c) - {n}), 0L, (s, i) -> s + element_at({table}, cast({h} % {BUCKETS} + 1 as int)))), 0L, (s, x) -> s + x), 0L)")
    n_grams = "+".join(f"greatest(length({part}) - {n - 1}, 0)" for part in ("host", "path") for n in LENGTHS)
    score = F.expr(f"cast(floor({bias}L * sqrt(cast(greatest({n_grams}, 1) as double))) as bigint) + " + " + ".join(total))
    host, path = F.col("host"), F.col("path")
    ruled = rule_of(host, path, rules, lambda v, h, p: v)
    return rows.withColumn("score", score).select("page_id", "host", "path", rule_of(host, path, rules, lambda v, h, p: h + p).alias("rule"), F.coalesce(ruled, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED) -> str:
    """The same as DuckDB SQL."""
    bias, weights = train(labelled)
    total = []
    for salt, part in enumerate(("host", "path")):
        for n in LENGTHS:
            h = str(10 * n + salt) + "::bigint"
            for k in range(n):
                h = f"(({h} * {BASE} + unicode(substring({part}, i + {k}, 1))) % 1000000007)"
            total.append(f"coalesce(list_sum(list_transform(range(1, length({part}) - {n - 2}), lambda i: w[({h} % {BUCKETS}) + 1])), 0)")
    n_grams = "+".join(f"greatest(length({part}) - {n - 1}, 0)" for part in ("host", "path") for n in LENGTHS)
    fits = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{what(v, h, p)}'" for v, h, p in fits) + " end"
    return f"""
with model as (select cast(string_split('{",".join(map(str, weights))}', ',') as bigint[]) as w),
urls as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
scored as (
  select *, cast(floor({bias} * sqrt(cast(greatest({n_grams}, 1) as double))) as bigint) + {" + ".join(total)} as score from urls, model)
select page_id, host, path, {case(lambda v, h, p: h + p)} as rule,
       coalesce({case(lambda v, h, p: v)}, case when score > 0 then 'block' else 'allow' end) as verdict from scored"""
