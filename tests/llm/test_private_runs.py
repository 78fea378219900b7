"""Base spans of personal data on long runs and odd neighbours, against the plain patterns."""

import random
import re
import time

from plumbline.llm import private_spans

# the plain forms of the base kinds
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def keep(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True, "ip": all(int(x) <= 255 for x in value.split(".")) if kind == "ip" else True,
        "card": kind == "card" and 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
    }[kind]


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if keep(kind, m.group())]
    return [x[2] for x in sorted(out)]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    rows = private_spans.find(df).collect()
    name = next(c for c in rows[0].asDict() if c.endswith("base"))
    return {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r[name]] for r in rows}


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "x_y@z-1.org", "_q%", "@", ".", "..", "1.2.3.4", "999.1.1.1", "10.0.0.256.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49", "7", " ", "-", "é", "(at)", " dot "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["a@b.com_x@y.org%z@w.de", None, ""]
    assert found(spark, texts) == {k: base(t) for k, t in enumerate(texts)}


def test_long_runs_end(spark):
    texts = ["7" * 1_000_000, "a" * 1_000_000, "1 " * 200_000, "a@" + "b." * 200_000 + "c", "x" * 5_000 + "@" + "y" * 5_000 + ".com"]
    began = time.time()
    got = found(spark, texts)
    assert time.time() - began < 120
    assert got[0] == got[1] == [] and got[3] == [f"email:0:{len(texts[3])}"] and got[4] == [f"email:0:{len(texts[4])}"]
