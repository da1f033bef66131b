"""Random keys inside runs that have symbols of two alphabets, or several keys."""

from __future__ import annotations

import random

from gridquill.llm import secrets
from tests.llm.fixtures import odd_docs
from tests.llm.test_text_stages import random_tokens


def test_keys_in_mixed_runs(spark):
    hexes, b64 = random_tokens()
    r = random.Random(7)
    alnum = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44)) for _ in range(60)]
    b64 = [f"{b[:10]}+{b[11:20]}/{b[21:]}" for b in b64]
    rows = [(i, f"see com/some-page/{k} now") for i, k in enumerate(alnum)]
    rows += [(100 + i, f"🙂 sha256-{k} now") for i, k in enumerate(b64)]
    rows += [(200 + i, f"{a}-{b}") for i, (a, b) in enumerate(zip(hexes[::2], hexes[1::2]))]
    rows += [(300 + i, "com/some-page/with-ordinary-words-in-it/and-then/some-more") for i in range(20)]
    found = {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"] if s["kind"] == 3] for x in secrets.scan_secrets(odd_docs(spark, rows)).collect()}
    text = dict(rows)
    hit = lambda doc, key: any(a <= text[doc].index(key) and b >= text[doc].index(key) + len(key) for a, b in found[doc])
    assert sum(hit(i, k) for i, k in enumerate(alnum)) >= 45
    assert sum(hit(100 + i, k) for i, k in enumerate(b64)) >= 45
    assert sum(hit(200 + i, a) and hit(200 + i, b) for i, (a, b) in enumerate(zip(hexes[::2], hexes[1::2]))) >= 20
    assert not any(found[300 + i] for i in range(20))
