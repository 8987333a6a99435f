"""The table of shards and spares: its text form, its durable state, and compare-and-swap changes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Aborted, CollectionError, InvalidArgument
from ..functions.vectors import even_counts, with_scheme
from .files import Files


@dataclass(frozen=True)
class Shard:
    address: str
    replicas: tuple[str, ...] = ()
    index_id: str = ""
    generation: int | None = None


@dataclass(frozen=True)
class Topology:
    shards: tuple[Shard, ...]
    spares: tuple[str, ...] = ()
    generation: int = 1
    version: int = 1

    def placed(self) -> set[str]:
        return {a for s in self.shards for a in (s.address, *s.replicas)}


def parse_table(text: str) -> Topology:
    """``primary|replica... [index [generation]]`` per entry; entries end at commas and lines, # starts a comment."""
    shards = []
    for line in text.splitlines():
        for entry in re.sub(r"#.*", "", line).split(","):
            if not (words := entry.split()):
                continue
            if len(words) > 3:
                raise InvalidArgument(f"{entry.strip()!r} has more than an address, an index and a generation")
            addresses = [a if "://" in a else f"http://{a}" for a in words[0].split("|")]
            if not all(a.partition("://")[2] for a in addresses):
                raise InvalidArgument(f"{entry.strip()!r} lacks an address")
            if len(words) == 3 and not words[2].isdigit():
                raise InvalidArgument(f"{words[2]!r} is no generation")
            shards.append(Shard(addresses[0], tuple(addresses[1:]), words[1] if len(words) > 1 else "", int(words[2]) if len(words) > 2 else None))
    return Topology(tuple(shards))


def parse_tables(texts: DataFrame, column: str = "text") -> DataFrame:
    """pos, address, replicas, index_id, generation of every entry of a column of tables, in the plan."""
    clean = F.regexp_replace(F.col(column), r"#[^\n]*", "")
    entries = texts.select(F.posexplode(F.split(clean, r"[,\n]")).alias("pos", "entry")).select("pos", F.trim(F.regexp_replace("entry", r"\s+", " ")).alias("entry"))
    w = F.split(F.col("entry"), " ")
    a = F.transform(F.split(F.get(w, 0), r"\|"), with_scheme)
    return entries.where("entry <> ''").select(
        "pos",
        F.get(a, 0).alias("address"),
        F.concat_ws("|", F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).alias("replicas"),
        F.coalesce(F.get(w, 1), F.lit("")).alias("index_id"),
        F.get(w, 2).cast("long").alias("generation"),
    )


class TopologyState:
    """The topology in one file. A state that exists wins over the table that the caller starts with."""

    def __init__(self, spark: SparkSession, root: str, start: Topology | None = None):
        self.files = Files(spark, root)
        self.files.make()
        if self.files.exists("topology.json"):
            self.now = self._parsed(self.files.read("topology.json"))
        elif start is None or not start.shards:
            raise CollectionError("empty_collection", "there is no shard and no saved state")
        else:
            self._save(start)

    @staticmethod
    def _parsed(text: str) -> Topology:
        d = json.loads(text)
        t = Topology(
            tuple(Shard(s["address"], tuple(s["replicas"]), s["index_id"], s["generation"]) for s in d["shards"]), tuple(d.get("spares", ())), d["generation"], d["version"]
        )
        if t.generation < 1 or not t.shards:
            raise CollectionError("empty_collection", "the saved state has no shard or no generation")
        return t

    def _save(self, t: Topology) -> None:
        self.files.replace("topology.json", json.dumps(asdict(t)))
        self.now = t

    def rebind(self, shards: tuple[Shard, ...], seen: int) -> Topology:
        """New shards, if nobody has changed the topology since generation ``seen`` (K11). Placed spares leave the pool."""
        if not shards:
            raise CollectionError("empty_collection", "a collection needs a shard")
        saved = self._parsed(self.files.read("topology.json"))
        if saved.generation != seen:
            raise Aborted(f"shard_generation_mismatch: the topology is at {saved.generation}, not {seen}")
        old = {s.address: s for s in saved.shards}
        shards = tuple(replace(s, replicas=s.replicas or (old[s.address].replicas if s.address in old else ())) for s in shards)
        placed = {a for s in shards for a in (s.address, *s.replicas)}
        self._save(replace(saved, shards=shards, spares=tuple(x for x in saved.spares if x not in placed), generation=seen + 1))
        return self.now

    def register(self, address: str, reachable: Callable[[str], bool]) -> bool:
        """Whether the address is a member; another reachable one becomes a spare, once (K9)."""
        address = address if "://" in address else f"http://{address}"
        if not reachable(address):
            raise CollectionError("node_unreachable", address)
        if address in self.now.placed():
            return True
        if address not in self.now.spares:
            self._save(replace(self.now, spares=(*self.now.spares, address)))
        return False


@dataclass(frozen=True)
class AutoscalePolicy:
    """Grows only: a shard above the ceiling is split in place onto spares, one a tick. No ceiling: off."""

    ceiling: int | None = None
    parts: int = 2


@dataclass
class Autoscaler:
    policy: AutoscalePolicy
    state: TopologyState
    done: list[str] = field(default_factory=list)

    def tick(self, sizes: dict[str, int], split: Callable[[Shard, list[str], list[int]], None]) -> str | None:
        """The address that was split, or None: none is too large, spares are missing, or the policy is off.

        split moves the rows: it gets the shard, the target addresses and the row count of each. The topology
        changes only after it has succeeded, in one swap.
        """
        t, need = self.state.now, self.policy.parts
        big = next((s for s in t.shards if self.policy.ceiling and sizes.get(s.address, 0) > self.policy.ceiling), None)
        if big is None or len(t.spares) < need:
            return None
        targets = list(t.spares[:need])
        split(big, targets, even_counts(sizes[big.address], need))
        at = t.shards.index(big)
        self.state.rebind((*t.shards[:at], *(Shard(a) for a in targets), *t.shards[at + 1 :]), t.generation)
        self.done.append(big.address)
        return big.address
