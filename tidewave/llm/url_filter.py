"""URL filter: glob rules simulated together by a bit-parallel Shift-And automaton.

Every rule ``(verdict, host, path)`` becomes two globs over the canonical form
``host + path``: ``host path *`` for the host itself and ``* . host path *`` for
its subdomains, where the leading star stands for host characters only (it can't
cross a ``/``). All globs are packed side by side into 64-bit words. One pass over
the bytes of a canonical URL advances every glob at once:

    D <- ((D << 1) & B[c]) | (D & S[c])

B[c] marks states that consume byte c, S[c] states that a star keeps alive on c.
The batch is the unit of work: one numpy step advances all URLs of a batch by one
byte, and URLs leave the batch when no state can change any more.

Defined results for odd input: a null url or one without ``://`` has an empty host
and path and fits no rule; a rule path of ``/`` doesn't fit an empty path; repeated
rows are judged alike and all returned; extra columns are ignored. An empty table
gives an empty result; without rules every URL gets the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import lower_ascii, require, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the op5 contract.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: What the method says where no rule fits.
DEFAULT_VERDICT = "allow"


class ShiftAnd:
    """All globs of all rules in one multiword state vector."""

    def __init__(self, rules: Sequence[Rule]):
        # The longest rule wins, an earlier one among equals: ranks by that order.
        self.order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text.encode()), i))
        globs = []  # (rank, whether a host star leads, literal bytes)
        for rank, i in enumerate(self.order):
            literal = rules[i].text.encode()
            globs += [(rank, False, literal), (rank, True, b"." + literal)]
        bits = sum(len(literal) + 1 for _, _, literal in globs)
        self.words = max(1, -(-bits // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.consume = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.final: list[tuple[int, int, np.uint64]] = []  # (rank, word, mask)
        self.finals = np.zeros(self.words, np.uint64)
        at = 0
        for rank, star, literal in globs:
            word, mask = self._bit(at)
            self.start[word] |= mask
            if star:
                for c in range(256):
                    if c != ord("/"):
                        self.stay[c, word] |= mask
            for k, c in enumerate(literal, 1):
                word, mask = self._bit(at + k)
                self.consume[c, word] |= mask
            self.stay[:, word] |= mask  # the trailing star keeps the final state
            self.finals[word] |= mask
            self.final.append((rank, word, mask))
            at += len(literal) + 1

    @staticmethod
    def _bit(at: int) -> tuple[int, np.uint64]:
        return at // 64, np.uint64(1) << np.uint64(at % 64)

    def best(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The rank of the best rule for each string of an Arrow buffer, or -1."""
        n = len(offsets) - 1
        ends, at = offsets[1:], offsets[:-1].copy()
        state = np.tile(self.start, (n, 1))
        live = np.flatnonzero(at < ends)
        one, top = np.uint64(1), np.uint64(63)
        while live.size:
            c = data[at[live]]
            d = state[live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            d = (moved & self.consume[c]) | (d & self.stay[c])
            state[live] = d
            at[live] += 1
            more = (at[live] < ends[live]) & ((d & ~self.finals) != 0).any(axis=1)
            live = live[more]
        out = np.full(n, -1, np.int64)
        for rank, word, mask in reversed(self.final):
            out[(state[:, word] & mask) != 0] = rank
        return out


def canonical(url):
    """Host and path columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT_VERDICT
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page's url."""
    require(pages, ["page_id", "url"])
    host, path = canonical(F.col("url"))
    urls = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    parts = urls.select("page_id", host.alias("host"), path.alias("path"))
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ShiftAnd(rules)
        text = [rules[i].text for i in machine.order] + [None]
        verdict = [rules[i].verdict for i in machine.order] + [default]
        for batch in batches:
            kind = pa.large_string()
            whole = pc.binary_join_element_wise(
                batch["host"].cast(kind), batch["path"].cast(kind), pa.scalar("", kind)
            )
            _, offsets, data = whole.buffers()
            offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            best = machine.best(offsets, data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"], batch["host"], batch["path"],
                    pa.array([text[i] for i in best], pa.string()),
                    pa.array([verdict[i] for i in best], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_FITS = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"

ORACLE = """
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), split as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), ruled as (
  select *, case
    when {en} then 'example.net/en/'
    when {de} then 'example.com/de/'
    when {fr} then 'org/fr/'
    when {net} then 'net/' end as rule
  from split
)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from ruled
""".format(
    en=_FITS.format(h="example.net", p="/en/"),
    de=_FITS.format(h="example.com", p="/de/"),
    fr=_FITS.format(h="org", p="/fr/"),
    net=_FITS.format(h="net", p="/"),
)

QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES = {"op5_url_filter": ORACLE}
