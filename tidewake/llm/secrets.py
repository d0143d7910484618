"""Secrets: candidates by pattern, and who owns each value over the whole corpus.

Pass one finds, in each text, the base spans (fixed patterns) and further
candidates: tokens with a vendor's prefix, signed tokens of three parts, mixed
random tokens, passwords in addresses, values after other telling words.  It
keeps a digest of each value, never the value, in a table in the shared folder.

Then digests are aggregated by owner and repository.  A value that looks live
and that stands with few owners and in few repositories is a credential of
theirs; one that many share is an example that was copied.  Only credentials
among the further candidates are added to the base spans, which always stay.

Digests go through two groupings, by (digest, owner, repository) and by
(digest, owner), so that a value in a third of all rows is combined before
each shuffle; the verdicts of values in a thousandth of all rows or more, a
thousand at most, are broadcast, and all others joined by digest.

Defined results: a null text is empty; a null owner or repository counts as
one of its own; a null id stays null; repeated rows stay and count for one
repository; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise, slices, text_of

BASE = ("assign", "access", "hex")
#: In order of precedence: of two that overlap the first stays.
MORE = ("vendor", "signed", "address", "cue", "random")
KINDS = (*BASE, *MORE)
MAX_OWNERS, MAX_REPOS = 1, 20


def either(word: str) -> str:
    """A pattern of an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_VALUE = r"[A-Za-z0-9+/_.=-]"
_SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({'|'.join(map(either, ('password', 'passwd', 'secret', 'token', 'api_?key')))}){_SET}({_VALUE}+)"
CUE = f"({'|'.join(map(either, ('passphrase', 'pwd', 'credential', 'private_?key', 'access_?key', 'auth_?key', 'signing_?key', 'bearer')))}){_SET}({_VALUE}+)"
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
ADDRESS = r"""://([^\x00-\x20:/@"'<>]+):([^\x00-\x20:/@"'<>]+)@"""
TOKEN = f"{_VALUE}{{20,}}"
VENDOR = r"^(gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[sr]k_live_|sk-|AIza|npm_|pypi-|hf_|SG\.)[A-Za-z0-9_.-]{16,}$"
SIGNED = r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$"
RANDOM = r"^([A-Za-z0-9+/]{32,126}={0,2}|[A-Za-z0-9_-]{32,128})$"
#: Words that a value of an example holds.
EXAMPLE = f"({'|'.join(map(either, ('example', 'sample', 'changeme', 'placeholder', 'dummy', 'redacted', 'your', 'test', 'xxxx')))}|123456)"
#: Different characters of a live value, and of a random token.
VARIED, MIXED = 6, 16

_assign, _cue, _access, _hex, _address, _token = map(re.compile, (ASSIGN, CUE, ACCESS, HEX, ADDRESS, TOKEN))
_vendor, _signed, _random, _example = map(re.compile, (VENDOR, SIGNED, RANDOM, EXAMPLE))
_classes = [re.compile(c) for c in ("[0-9].*[0-9].*[0-9]", "[A-Z].*[A-Z].*[A-Z]", "[a-z].*[a-z].*[a-z]")]


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    value: str


def base_spans(text: str) -> list[Found]:
    """The base spans with their values, by start and kind."""
    out = [Found("assign", m.start(), m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= 6]
    out += [Found("access", m.start(), m.end(), m[0]) for m in _access.finditer(text)]
    out += [Found("hex", m.start(), m.end(), m[0]) for m in _hex.finditer(text)]
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind)))


def kind_of(token: str) -> str | None:
    """What a long token is by its form."""
    if _vendor.match(token):
        return "vendor"
    if _signed.match(token):
        return "signed"
    if _random.match(token) and len(set(token)) >= MIXED and all(c.search(token) for c in _classes):
        return "random"
    return None


def further_spans(text: str, base: list[Found]) -> list[Found]:
    """Candidates that touch neither a base span nor a candidate of an earlier kind, by start."""
    found = []
    for m in _token.finditer(text):
        token = m[0].rstrip(".")
        kind = kind_of(token)
        if kind:
            found.append(Found(kind, m.start(), m.start() + len(token), token))
    found += [Found("address", m.start(), m.end(), m[2]) for m in _address.finditer(text) if len(m[2]) >= 6]
    found += [Found("cue", m.start(), m.end(), m[2]) for m in _cue.finditer(text) if len(m[2]) >= 8 and re.search("[0-9]", m[2])]
    if not found:
        return []
    order = sorted([(f.start, f.end, KINDS.index(f.kind), f) for f in (*base, *found)], key=lambda f: f[:3])
    return [f for _, _, rank, f in without_overlaps(order) if rank >= len(BASE)]


def without_overlaps(order: list[tuple[int, int, int, Found]]) -> list[tuple[int, int, int, Found]]:
    """Those that overlap none of a lower rank (whether that one stays or not); a rank's own never overlap."""
    stay = []
    reach = [-1] * len(KINDS)  # how far the spans of a rank reached so far
    for f in order:
        if all(reach[k] <= f[0] for k in range(f[2])):
            stay.append(f)
        reach[f[2]] = max(reach[f[2]], f[1])
    # The same from the right, for those that begin within a higher-ranked one.
    out, reach = [], [1 << 62] * len(KINDS)
    seen = set(map(id, stay))
    for f in reversed(order):
        if id(f) in seen and all(reach[k] >= f[1] for k in range(f[2])):
            out.append(f)
        reach[f[2]] = min(reach[f[2]], f[0])
    return out[::-1]


def looks_live(value: str) -> bool:
    return len(set(value)) >= VARIED and _example.search(value) is None


_SPAN = "array<struct<kind: string, start: long, end: long, digest: binary, live: boolean>>"
SCANNED = f"row long, doc_id long, owner string, repo string, base {_SPAN}, more {_SPAN}"


def scan(docs: DataFrame, owner_col: str, repo_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document (``row`` numbers them): its base spans and further candidates with their values' digests."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary()), ("live", pa.bool_())]))

    def told(found: list[Found]) -> list[dict[str, object]]:
        return [{"kind": f.kind, "start": f.start, "end": f.end, "digest": blake2b(f.value.encode(), digest_size=16).digest(), "live": looks_live(f.value)} for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text"):
            base, more = [], []
            for raw in b.column(3).to_pylist():
                text = raw.decode("utf-8", "replace")
                fixed = base_spans(text)
                base.append(told(fixed))
                more.append(told(further_spans(text, fixed)))
            columns = [pa.array(range(at, at + b.num_rows), pa.int64()), b.column(0), b.column(1), b.column(2), pa.array(base, span), pa.array(more, span)]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "owner", "repo", "base", "more"])

    def named(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), named(owner_col).alias("owner"), named(repo_col).alias("repo"), text_of(docs, text_col)).mapInArrow(run, SCANNED)


def ownership(scanned: DataFrame) -> DataFrame:
    """``digest, owners, repos, n_rows``: by whom and where each value is held."""
    held = scanned.select("owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s.digest))).alias("digest"))
    by_repo = held.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n_rows"))


def find(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, id_col: str = "doc_id", text_col: str = "text", share: int = 1000) -> DataFrame:
    """A row a document: ``doc_id``, ``base`` spans and ``added`` ones, each with ``kind, start, end, owned``.

    ``owned`` says that the value looks live and belongs to at most ``max_owners``
    owners and ``max_repos`` of their repositories.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.materialise(scan(docs, owner_col, repo_col, id_col, text_col), "secrets")
        held = scratch.materialise(ownership(rows).withColumn("few", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)), "owners")
        total = held.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        # Each has a share of 1 in ``share`` of all rows, so there are ``share`` at most.
        common = held.filter(F.col("n_rows") >= max(1000, total / share)).select("digest", "few")
        some = F.size("base") + F.size("more") > 0
        each = rows.filter(some).select("row", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s.digest))).alias("digest"))
        rare = each.join(F.broadcast(common.select("digest")), "digest", "left_anti").join(held.filter("few").select("digest").hint("merge"), "digest", "left_semi")
        mine = each.join(F.broadcast(common.filter("few").select("digest")), "digest", "left_semi").unionByName(rare)
        of_row = mine.groupBy("row").agg(F.collect_list("digest").alias("owned"))
        judged = rows.filter(some).join(of_row.hint("merge"), "row", "left").withColumn("owned", F.coalesce("owned", F.array().cast("array<binary>")))

        def told(c: str) -> Column:
            return F.transform(c, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), (s.live & F.array_contains("owned", s.digest)).alias("owned")))

        full = judged.select("doc_id", told("base").alias("base"), F.filter(told("more"), lambda s: s.owned).alias("added"))
        none = rows.filter(~some).select("doc_id", F.array().cast(full.schema["base"].dataType).alias("base"), F.array().cast(full.schema["added"].dataType).alias("added"))
        return materialise(full.unionByName(none), "found-secrets")


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text; ``n_owned`` of these are credentials of their owners."""

    def lines(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    rank = F.lit(list(KINDS))
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s.start.alias("start"), F.array_position(rank, s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
    owned = F.size(F.filter(F.concat("base", "added"), lambda s: s.owned)).cast("long").alias("n_owned")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(lines(F.col("base")), 256).alias("base_sha256"), lines(both).alias("spans"), owned)


def oracle() -> str:
    """The same in SQL, with plain distinct counts over the values themselves."""

    def q(pattern: str) -> str:
        return pattern.replace("'", "''")

    def matches(kind: str, pattern: str, group: int, check: str) -> str:
        return f"""
  select r, '{kind}' as kind, m, v, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) as start
  from (select r, gaps, ms, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(vs) as v from (
    select r, string_split_regex(t, '{q(pattern)}') as gaps, regexp_extract_all(t, '{q(pattern)}') as ms, regexp_extract_all(t, '{q(pattern)}', {group}) as vs from texts))
  where {check}"""

    varied = "len(list_distinct(string_split(v, '')))"
    tokens = matches("token", TOKEN, 0, "true")
    classes = " and ".join(f"regexp_matches(v, '[{c}].*[{c}].*[{c}]')" for c in ("0-9", "A-Z", "a-z"))
    rank = "list_position(['" + "', '".join(KINDS) + "'], kind)"
    return rf"""
with texts as materialized (
  select row_number() over () as r, doc_id, coalesce('=' || source, '') as owner, coalesce('=' || doc_id, '') as repo, coalesce("text", '') as t from documents),
base as materialized ({matches("assign", ASSIGN, 2, "len(v) >= 6")} union all {matches("access", ACCESS, 0, "true")} union all {matches("hex", HEX, 0, "true")}),
tokens as (
  select r, start, rtrim(m, '.') as v from ({tokens})),
more as materialized (
  select r, case when regexp_matches(v, '{q(VENDOR)}') then 'vendor' when regexp_matches(v, '{q(SIGNED)}') then 'signed'
    when regexp_matches(v, '{q(RANDOM)}') and {varied} >= {MIXED} and {classes} then 'random' end as kind, v as m, v, start from tokens
  union all {matches("address", ADDRESS, 2, "len(v) >= 6")}
  union all {matches("cue", CUE, 2, "len(v) >= 8 and regexp_matches(v, '[0-9]')")}),
spans as materialized (
  select *, {rank} as rank, cast(start as bigint) as s, cast(start + len(m) as bigint) as e, {varied} >= {VARIED} and not regexp_matches(v, '{q(EXAMPLE)}') as live
  from (select * from base union all select * from more where kind is not null)),
candidates as materialized (
  select a.* from spans a where a.rank <= {len(BASE)} or not exists (
    select 1 from spans b where b.r = a.r and b.rank < a.rank and b.s < a.e and a.s < b.e)),
held as (
  select v, count(distinct owner) as owners, count(distinct owner || chr(0) || repo) as repos from candidates c join texts t on t.r = c.r group by v),
judged as (
  select c.*, live and owners <= {MAX_OWNERS} and repos <= {MAX_REPOS} as owned from candidates c join held h on h.v = c.v),
shown as (select *, kind || ':' || s || ':' || e as line from judged where rank <= {len(BASE)} or owned)
select t.doc_id, count(s.r) filter (where kind = 'assign') as n_assign, count(s.r) filter (where kind = 'access') as n_access,
  count(s.r) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(line, ',' order by s, rank) filter (where rank <= {len(BASE)}), '')) as base_sha256,
  coalesce(string_agg(line, ',' order by s, rank), '') as spans, count(s.r) filter (where owned) as n_owned
from texts t left join shown s on s.r = t.r group by t.r, t.doc_id"""
