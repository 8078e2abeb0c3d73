"""What an evolving source has to offer so that policies can keep answers over it: worlds, truth and
evidence as tables over (key, version). Anything with these methods plugs in; Lake does it for a change log."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import evidence, manifest, policies, profile


class Environment(Protocol):
    """Tables are long: a key is iid, a version t."""

    def versions(self) -> DataFrame:
        """The version axis: t."""

    def world(self, t: int) -> DataFrame:
        """The files of one version: path, sha."""

    def keys(self) -> DataFrame:
        """Stored answers: iid and what it depends on."""

    def truth(self) -> DataFrame:
        """What holds: iid, t, truth (canonical text, NONE if its referent doesn't exist)."""

    def states(self) -> DataFrame:
        """The fingerprint of the evidence: iid, t, state."""

    def canonical(self, given, known):
        """A given answer (column) in the form of a known one."""

    def cost(self) -> DataFrame:
        """What deriving anew costs: iid, t, tokens."""


class Lake:
    """Facts (iid, ds, period) over a change log (path, idx, sha) of part files and their profiles (sha, n).

    pattern: of a path, with the groups dataset and month.
    """

    def __init__(self, log: DataFrame, profiles: DataFrame, facts: DataFrame, pattern: str, tokens: int = 1000):
        self.intervals, self.profiles, self.facts, self.pattern, self.tokens = manifest.fold(log), profiles, facts, pattern, tokens
        self.snapshots = log.select("idx").distinct()

    def versions(self) -> DataFrame:
        return self.snapshots.select(F.col("idx").alias("t"))

    def world(self, t: int) -> DataFrame:
        return manifest.world(self.intervals, t)

    def keys(self) -> DataFrame:
        return self.facts

    def series(self) -> DataFrame:
        """iid, t, n (null where no file is relevant) and the dependency key."""
        part = lambda i: F.regexp_extract("path", self.pattern, i)
        worlds = manifest.worlds(self.intervals, self.snapshots).select("idx", "path", "sha", part(1).alias("ds"), part(2).alias("month"))
        facts = self.facts.select(F.col("iid").alias("fact"), "ds", "period")
        got = profile.fact_series(facts, worlds, self.profiles, ["n"]).select(F.col("fact").alias("iid"), F.col("idx").alias("t"), "n", "dep")
        first, last = self.snapshots.agg(F.min("idx"), F.max("idx")).first()
        every = F.explode(F.sequence(F.lit(first), F.lit(last))) if first is not None else F.lit(None).cast("long")
        grid = self.facts.select("iid", every.alias("t")).join(self.versions(), "t", "left_semi")
        return grid.join(got, ["iid", "t"], "left")

    def truth(self) -> DataFrame:
        return self.series().select("iid", "t", scalar.answer(F.col("n")).alias("truth"))

    def states(self) -> DataFrame:
        return self.series().select("iid", "t", F.coalesce("dep", F.lit("")).alias("state"))

    def canonical(self, given, known):
        return scalar.canonical_answer(given, known)

    def cost(self) -> DataFrame:
        return self.series().select("iid", "t", F.lit(self.tokens).alias("tokens"))


def reads(env: Environment) -> DataFrame:
    """What policies run over: iid, t, truth, state, tokens."""
    return env.truth().join(env.states(), ["iid", "t"]).join(env.cost(), ["iid", "t"])


def keep(env: Environment, policy: str) -> DataFrame:
    """A policy by name over an environment: iid, t, derived, served, wrong."""
    return policies.run(policy, reads(env)).select("iid", "t", "derived", "served", "wrong")


def changes(env: Environment) -> DataFrame:
    """Where the evidence of a key changes: iid, t, state."""
    return evidence.change_points(env.states(), ["iid"], "t").where("changed").select("iid", "t", "state")
