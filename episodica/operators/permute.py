"""A keyed order of 0 .. n-1 that can be asked anywhere, forwards and backwards.

An epoch order by sorting costs a shuffle and knows a place only after all others.
Here a number is written as two digits (left, right) of radices near the square root
of n; every round adds a keyed hash of one digit to the other, which can be taken back,
so all rounds together are a bijection (a Feistel network).  The few numbers of the
grid beyond n are walked on until they fall below it.  A job that restarts at place p
of the epoch so needs the samples of places p, p+1, ... and nothing else.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: rounds; an even number leaves each digit in its own place
ROUNDS = 6

#: walks beyond which a number outside of 0 .. n-1 is an error; each fails once in sqrt(n) times
WALKS = 32

#: numbers up to which the products of a round stay below 2^63
LARGEST = 1 << 60


class Permutation:
    """The order of ``n`` numbers under (seed, epoch)."""

    def __init__(self, n: int, seed: int = 0, epoch: int = 0):
        if not 0 <= n <= LARGEST:
            raise ValueError(f"cannot order {n} numbers")
        self.n = n
        self.left = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.right = max(1, -(-n // self.left))
        # a bijection of the grid leaves its outside after at most so many steps
        self.walks = min(self.left * self.right - n, WALKS)
        self.keys = []
        for t in range(ROUNDS):
            h = int.from_bytes(hashlib.md5(f"{seed}|{epoch}|{t}".encode()).digest(), "big")
            # an odd factor of 31 bits and an offset of 61
            self.keys.append((h % (1 << 30) * 2 + 1, (h >> 40) % (1 << 61), self.left if t % 2 == 0 else self.right))

    def _rounds(self) -> list[Column]:
        return [F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c"), F.lit(m).cast("long").alias("m")) for a, c, m in self.keys]

    @staticmethod
    def _mix(v: Column, k: Column) -> Column:
        z = v * k["a"] + k["c"]
        return z.bitwiseXOR(F.shiftright(z, 17)) % k["m"]

    def _digits(self, x: Column) -> Column:
        v = x % F.lit(self.right)
        # the remainder is taken off first, so the division is exact in whole numbers
        return F.struct(F.call_function("div", x - v, F.lit(self.right)).cast("long").alias("u"), v.cast("long").alias("v"))

    def _once(self, x: Column) -> Column:
        start = self._digits(x)
        turn = lambda d, k: F.struct(d["v"].alias("u"), ((d["u"] + self._mix(d["v"], k)) % k["m"]).alias("v"))
        return F.aggregate(F.array(*self._rounds()), start, turn, lambda d: d["u"] * self.right + d["v"])

    def _back(self, x: Column) -> Column:
        start = self._digits(x)
        turn = lambda d, k: F.struct(F.pmod(d["v"] - self._mix(d["u"], k), k["m"]).alias("u"), d["u"].alias("v"))
        return F.aggregate(F.array(*self._rounds()[::-1]), start, turn, lambda d: d["u"] * self.right + d["v"])

    def _walk(self, x: Column, step) -> Column:
        x = x.cast("long")
        y = step(x)
        if self.walks:
            y = F.aggregate(F.sequence(F.lit(1), F.lit(self.walks)), y, lambda v, _: F.when(v >= self.n, step(v)).otherwise(v))
        lost = F.raise_error(F.lit("no place found")).cast("long")
        return F.when((x >= 0) & (x < self.n), F.when(y >= self.n, lost).otherwise(y))

    def place(self, number: Column) -> Column:
        """Place of a number in the order; null outside of 0 .. n-1."""
        return self._walk(number, self._once)

    def number(self, place: Column) -> Column:
        """Number at a place of the order: the inverse of :meth:`place`."""
        return self._walk(place, self._back)

    def sql(self, x: str) -> str:
        """One pass over the grid as SQL (without the walk), for checks in other engines."""
        u, v = f"(({x}) // {self.right})", f"(({x}) % {self.right})"
        for a, c, m in self.keys:
            z = f"({v} * {a} + {c})"
            u, v = v, f"(({u} + xor({z}, {z} >> 17) % {m}) % {m})"
        return f"({u} * {self.right} + {v})"


def epoch_order(samples: DataFrame, idx: str, n: int, seed: int = 0, epoch: int = 0, out: str = "place") -> DataFrame:
    """``samples`` (``idx`` being 0 .. n-1) with their place in the epoch; nothing is sorted or shuffled."""
    return samples.withColumn(out, Permutation(n, seed, epoch).place(F.col(idx)))


def epoch_part(spark: SparkSession, n: int, start: int, stop: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(place, sample_no) of the places ``start`` to ``stop`` alone, as a restart needs them."""
    p = Permutation(n, seed, epoch)
    return spark.range(max(0, start), min(stop, n)).select(F.col("id").alias("place"), p.number(F.col("id")).alias("sample_no"))


def epoch_batches(samples: DataFrame, idx: str, n: int, batch_size: int, world: int = 1, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Batch, slot and rank of every sample; the last, incomplete batch of the epoch is left out."""
    d = epoch_order(samples, idx, n, seed, epoch)
    d = d.where(F.col("place") < n // batch_size * batch_size)
    batch = F.floor(F.col("place") / batch_size)
    return d.withColumns({"batch_no": batch, "slot": F.col("place") % batch_size, "rank": batch % world})
