"""Names, slugs and paths are no secrets: the p values hold for thousands of ordinary tokens, and the reported share stays under the rate."""

from __future__ import annotations

import functools
import json
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridquill.llm import secrets
from tests.llm.fixtures import odd_docs

EACH = 1000


@functools.cache
def words():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return sorted({w for w in (re.sub("[^a-z]", "", v) for v in vocabulary) if 2 <= len(w) <= 12})


def invented(r):
    """A word of a made-up language, by syllables."""
    return "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "st"]) for _ in range(r.randint(1, 4)))


def ordinary(kind, r):
    word = lambda: r.choice(words()) if r.random() < 0.8 else invented(r)
    number = lambda: str(r.randrange(r.choice([10, 100, 10_000])))
    parts, size = [], r.randint(20, 64)
    while sum(map(len, parts)) < size:
        w = word()
        if kind == "camel short" and len(w) > 5:
            continue
        parts.append(w.capitalize() if kind.startswith("camel") or kind == "mixed" else w)
        if kind in ("camel digits", "snake", "slug", "path") and r.random() < 0.35:
            parts.append(number())
        if kind == "mixed":
            parts.append(r.choice([word()[:3].upper(), number(), word().capitalize()]))
    return {"snake": "_", "slug": "-", "path": "/"}.get(kind, "").join(parts) if kind != "upper" else "".join(parts).upper()


KINDS = ("camel", "camel short", "camel digits", "snake", "slug", "path", "lower", "upper", "mixed")


def secret(alphabet, length, r):
    return "".join(r.choice(alphabet) for _ in range(length))


B64 = string.ascii_letters + string.digits + "+/"


def reported(spark, rows):
    return {x["doc_id"] for x in secrets.scan_secrets(odd_docs(spark, rows)).collect() if any(s["kind"] == 3 for s in x["spans"])}


def test_p_values_hold_for_ordinary_tokens(spark):
    r = random.Random(1)
    tokens = [(k, ordinary(k, r)) for k in KINDS for _ in range(EACH)]
    rows = spark.createDataFrame(tokens, "kind string, t string").select("kind", secrets.token_tests(F.col("t"))["bin"].alias("bin")).collect()
    for kind in KINDS:
        p = 10.0 ** ((np.array([x["bin"] for x in rows if x["kind"] == kind]) + 1) / secrets.BINS_PER_DECADE + secrets.LOWEST)
        for most in (0.05, 0.01, 0.002):
            assert (p <= most).mean() <= most, (kind, most)
        assert (p <= 1e-4).sum() == 0, kind


@pytest.mark.parametrize("kind", ["camel digits"])
def test_a_table_of_ordinary_tokens_alone(spark, kind):
    r = random.Random(2)
    assert not reported(spark, [(i, f"class {ordinary(kind, r)} of {ordinary('snake', r)}") for i in range(1500)])


def test_the_reported_share_of_ordinary_tokens(spark):
    r = random.Random(3)
    rows = [(i, f"see {ordinary(r.choice(KINDS), r)} now") for i in range(4000)]
    rows += [(20_000 + i, f"key {secret(B64, r.choice([32, 40, 44, 64]), r)} here") for i in range(300)]
    found = reported(spark, rows)
    false = sum(i < 20_000 for i in found)
    assert false <= 0.05 * len(found)
    assert len(found) - false >= 270


def test_recall_by_length_and_alphabet(spark):
    """One secret among a hundred ordinary tokens; README states these shares."""
    r = random.Random(4)
    least = {(B64, 24): 0.6, (B64, 44): 0.9, ("0123456789ABCDEF", 64): 0.8, (string.ascii_uppercase + "234567", 64): 0.2}
    for (alphabet, length), share in least.items():
        rows = [(i, ordinary(r.choice(KINDS), r)) for i in range(1500)] + [(10_000 + i, secret(alphabet, length, r)) for i in range(15)]
        found = reported(spark, rows)
        assert sum(i >= 10_000 for i in found) >= share * 15, (alphabet, length, len(found))
        assert sum(i < 10_000 for i in found) <= max(1, 0.05 * len(found))


def test_patterns_and_rates(spark):
    rows = [(i, t) for i, t in enumerate(["0123456789abcdef" * 2, "ab" * 30, "0" * 40, "abcdefghijklmnopqrstuvwxyz0123456789"])]
    rows += [(100 + i, secret(B64, 44, random.Random(i))) for i in range(100)]
    found = reported(spark, rows)
    assert not {i for i in found if i < 4} - {0} and len(found) >= 90  # the first is a base span as well
    with pytest.raises(ValueError, match="rate"):
        secrets.scan_secrets(odd_docs(spark, rows), rate=0.5)
