"""Collections with versions, and aliases that every session sees.

A collection is a folder of Parquet files, ``{alias}__v{n}``, with its embedding profile in
a small file beside it.  An alias is a row of numbered pointer files; the greatest number
counts.  A switch puts the next number in place only if it is not there: a writer that
expected another collection, or is too late, is refused and changes nothing.

A reader binds to the version that the alias points at, by a lease: a file that is written
first, after which the alias is read again; only if it still points there does the reader
keep it.  A version is deleted (``retire``) once no alias points at it and then no lease on
it is left, so a reader who holds a lease keeps its files.  A lease ends with its reader,
or, where that was lost, after its time.  The clocks of the machines that start sessions
must agree to within much less than a lease's time.

Files are listed and written through the file system that holds the folder; what is listed
is names of collections, pointers and leases, never rows.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rillmark.sources import work

#: Seconds after which the lease of a lost reader ends.
LEASE = 86_400


class Refused(Exception):
    """A switch to what is not there or does not fit, or a switch that came too late."""


@dataclass(frozen=True)
class Profile:
    """What the vectors of a collection were made with."""

    fingerprint: str
    provider: str = "hash"
    dimension: int = 384
    revision: str = ""

    def serves(self, wanted: Profile) -> bool:
        """Equal fingerprints, or hash embeddings of equal dimension and revision."""
        hashed = self.provider == wanted.provider == "hash" and (self.dimension, self.revision) == (wanted.dimension, wanted.revision)
        return hashed or self.fingerprint == wanted.fingerprint


@dataclass(frozen=True)
class Catalogue:
    spark: SparkSession
    at: str

    def collections(self) -> list[str]:
        return [n for n in work.names(self.spark, self.at) if not n.startswith(("_", "."))]

    def versions(self, alias: str) -> list[str]:
        """The alias's collections by version, the latest last."""
        numbered = [(n.removeprefix(f"{alias}__v"), n) for n in self.collections() if n.startswith(f"{alias}__v")]
        return [n for _, n in sorted((int(v), n) for v, n in numbered if v.isdecimal())]

    def profile(self, name: str) -> Profile | None:
        """A collection's profile; none for one that was not made here."""
        at = f"{self.at}/_profiles/{name}.json"
        return Profile(**json.loads(work.get(self.spark, at))) if work.exists(self.spark, at) else None

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    def _pointer(self, alias: str) -> tuple[int, str | None]:
        held = [int(n.removesuffix(".json")) for n in work.names(self.spark, f"{self.at}/_aliases/{alias}") if n.endswith(".json")]
        if not held:
            return 0, None
        return max(held), json.loads(work.get(self.spark, f"{self.at}/_aliases/{alias}/{max(held)}.json"))["collection"]

    def active(self, alias: str) -> str | None:
        return self._pointer(alias)[1]

    def write(self, alias: str, rows: DataFrame, profile: Profile, key: str = "chunk_id") -> str:
        """The next version, one row for each key; nobody sees it before a switch.  Of two
        writers the later takes the number after."""
        number = max([int(n.rpartition("__v")[2]) for n in self.versions(alias)], default=0) + 1
        name = f"{alias}__v{number}"
        # the profile is put in place once and so claims the number
        while not work.put_once(self.spark, f"{self.at}/_profiles/{name}.json", json.dumps(asdict(profile)).encode()):
            number += 1
            name = f"{alias}__v{number}"
        rows.dropDuplicates([key]).write.parquet(f"{self.at}/{name}")
        return name

    def switch(self, alias: str, name: str, wanted: Profile | None = None, expected: str | None = None) -> None:
        """Point the alias at a collection.  Refused if it is not there whole, if its profile
        does not serve ``wanted``, if the alias does not point at ``expected`` (where that is
        given), or if another writer switches at the same time."""
        number, now = self._pointer(alias)
        if expected is not None and now != expected:
            raise Refused(f"{alias} points at {now}, not at {expected}")
        if now == name:
            return
        if not work.exists(self.spark, f"{self.at}/{name}/_SUCCESS"):
            raise Refused(f"{name} is not there, or not written to its end")
        have = self.profile(name)
        if wanted is not None and (have is None or not have.serves(wanted)):
            raise Refused(f"{name} has other embeddings: reindex")
        if not work.put_once(self.spark, f"{self.at}/_aliases/{alias}/{number + 1}.json", json.dumps({"collection": name}).encode()):
            raise Refused(f"{alias} was switched meanwhile")

    def ensure(self, alias: str, schema: T.StructType, wanted: Profile) -> str:
        """The collection that serves ``wanted``, with the alias on it: the active one, else
        the latest version that does, else a collection of the alias's own name from before
        there were versions, which is adopted if it has the columns.  Where there is nothing,
        or that collection is empty, a first version, empty, is made.  Refused where there are
        rows with other embeddings or columns only."""
        fields = {(f.name, f.dataType) for f in schema}

        def fits(name: str) -> bool:
            have = self.profile(name)
            return work.exists(self.spark, f"{self.at}/{name}/_SUCCESS") and have is not None and have.serves(wanted) and {(f.name, f.dataType) for f in self.rows(name).schema} == fields

        now, versions = self.active(alias), self.versions(alias)
        for name in [*([now] if now in self.collections() else []), *reversed(versions)]:
            if fits(name):
                self.switch(alias, name, wanted)
                return name
        if alias in self.collections() and self.profile(alias) is None and {(f.name, f.dataType) for f in self.rows(alias).schema} == fields and not self.rows(alias).isEmpty():
            work.put_once(self.spark, f"{self.at}/_profiles/{alias}.json", json.dumps(asdict(wanted)).encode())
            self.switch(alias, alias, wanted)
            return alias
        if now is not None and not self.rows(now).isEmpty() or now is None and alias in self.collections() and not self.rows(alias).isEmpty():
            raise Refused(f"{alias} has rows with other embeddings or columns: reindex")
        name = self.write(alias, self.spark.createDataFrame([], schema), wanted, schema.names[0])
        self.switch(alias, name, wanted)
        return name

    @contextlib.contextmanager
    def reading(self, alias: str, seconds: int = LEASE) -> Iterator[DataFrame]:
        """The rows that the alias points at, held until the block ends."""
        while True:
            name = self.active(alias)
            if name is None:
                raise Refused(f"{alias} points at nothing")
            lease = f"{self.at}/_readers/{name}/{uuid.uuid4().hex}.json"
            work.put(self.spark, lease, json.dumps({"until": time.time() + seconds}).encode())
            if self.active(alias) == name:
                break
            work.delete(self.spark, lease)
        try:
            yield self.rows(name)
        finally:
            work.delete(self.spark, lease)

    def retire(self, name: str) -> bool:
        """Delete a collection; False, and no change, while an alias points at it or a
        reader holds it."""
        if any(self.active(a) == name for a in work.names(self.spark, f"{self.at}/_aliases")):
            return False
        for n in work.names(self.spark, f"{self.at}/_readers/{name}"):
            with contextlib.suppress(Exception):  # its reader ends it at this moment
                if json.loads(work.get(self.spark, f"{self.at}/_readers/{name}/{n}"))["until"] <= time.time():
                    work.delete(self.spark, f"{self.at}/_readers/{name}/{n}")
        if work.names(self.spark, f"{self.at}/_readers/{name}"):
            return False
        work.delete(self.spark, f"{self.at}/{name}")
        return True

    def reindex(self, alias: str, rows: DataFrame, profile: Profile, keep: bool = True, key: str = "chunk_id") -> str:
        """Write all rows as the next version, then switch.  Without ``keep`` the version
        before goes, if nobody reads it; else a later ``retire`` takes it.  If the alias
        moved meanwhile the switch is refused and the new version stays unseen."""
        number, before = self._pointer(alias)
        name = self.write(alias, rows, profile, key)
        if self._pointer(alias)[0] != number:
            raise Refused(f"{alias} was switched while {name} was written")
        self.switch(alias, name, profile, before)
        if before is not None and not keep:
            self.retire(before)
        return name
