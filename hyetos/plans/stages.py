"""Stages of a chain as tables, each known by a fingerprint of what made it.

A stage's fingerprint is a hash of its name, its own parameters and the fingerprints of its inputs. A stage is written
once, to a folder of its own that gets its name when it is complete; whoever asks for the same stage again, in this run or a
later one over the same root, reads that table. So a parameter decides only over the stages that depend on it, and a
chain that was broken off goes on where it stopped.

Inputs are told apart by a key that the caller vouches for, by their content (`content_key`), or not at all: without a key
each `source` is a new one, and nothing is taken over from earlier runs.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyetos.sources import folders


def content_key(df: DataFrame) -> str:
    """A key of the rows of a table, whatever their order: schema, number, and two sums of hashes, in one pass."""
    every = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    one = df.select(F.xxhash64(every).alias("a"), F.xxhash64(every, F.lit(1)).alias("b"))
    sums = one.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{sorted(df.dtypes)} {tuple(map(str, sums))}".encode()).hexdigest()


@dataclass(frozen=True)
class Stage:
    name: str
    fingerprint: str
    df: DataFrame


@dataclass
class Stages:
    """The stages under a folder. `made` lists those that this object has written, `found` those that it has read only."""

    spark: SparkSession
    root: str = ""
    made: list[str] = field(default_factory=list)
    found: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.root = self.root or f"{folders.shared_dir(self.spark)}/stages-{uuid.uuid4().hex}"

    def source(self, df: DataFrame, key: str | None = None) -> Stage:
        """An input. Without a key it is like no other, and kept as a table, so that its own plan runs once."""
        if key is None:
            return self.stage("source", lambda: df, unique=uuid.uuid4().hex)
        return Stage("source", key, df)

    def fingerprint(self, name: str, *inputs: Stage, **parameters) -> str:
        said = json.dumps([name, [x.fingerprint for x in inputs], parameters], sort_keys=True, default=repr)
        return hashlib.sha256(said.encode()).hexdigest()[:32]

    def stage(self, name: str, make: Callable[..., DataFrame], *inputs: Stage, **parameters) -> Stage:
        """The table of `make(*tables of inputs)`. `parameters` are all that `make` depends on besides; they go into the fingerprint."""
        key = self.fingerprint(name, *inputs, **parameters)
        path = f"{self.root}/{name}-{key}"
        if folders.exists(self.spark, f"{path}/_SUCCESS"):
            self.found.append(name)
        else:
            unfinished = f"{self.root}/unfinished-{name}-{uuid.uuid4().hex}"
            make(*[x.df for x in inputs]).write.parquet(unfinished)
            if not folders.publish(self.spark, unfinished, path):
                folders.delete(self.spark, unfinished)
            self.made.append(name)
        return Stage(name, key, self.spark.read.parquet(path))

    def remove(self) -> None:
        """Delete all stages under the root."""
        folders.delete(self.spark, self.root)
