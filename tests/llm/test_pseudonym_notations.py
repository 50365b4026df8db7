"""Phone numbers outside NANP, and cards inside longer runs of digits."""

from __future__ import annotations

import re

from quillon.llm import pseudonyms

TEXTS = ["+1 (017) 555-7713", "again +1 (017) 555-7713", "017-555-7713", "(212) 155-0123", "212.055.0123", "+1 999 100 0000", "count 100 200 3000", "4111 1111 1111 1111 123", "12 4111-1111-1111-1111", "1234 4111 1111 1112"]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_notations(spark):
    more = [f"4111 1111 1111 1111 {i:03d}" for i in range(0, 1000, 25)]
    docs = spark.createDataFrame(list(enumerate(TEXTS + more)), "doc_id long, text string")
    made = pseudonyms.pseudonymise(docs, key="k")
    rows = [(r["text"], r["n_replaced"]) for r in made.orderBy("doc_id").collect()]
    out = [t for t, _ in rows]
    assert [n for _, n in rows[: len(TEXTS)]] == [1, 1, 1, 1, 1, 1, 0, 1, 1, 0]
    assert out[1] == f"again {out[0]}" and re.sub(r"\D", "", out[0])[1:] == out[2].replace("-", "")
    for a, b in zip(TEXTS, out):
        assert re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b)
    assert not re.match(r"[2-9]..[2-9]", re.sub(r"\D", "", out[0])[1:])
    assert luhn(out[7][:19].replace(" ", "")) and out[7].endswith(" 123") and out[7][:19] != TEXTS[7][:19]
    assert luhn(out[8][3:].replace("-", "")) and out[8].startswith("12 ")
    assert all(a != b for a, b in zip(more, out[len(TEXTS) :]))
    back = pseudonyms.pseudonymise(made, key="k", reveal=True)
    assert [r["text"] for r in back.orderBy("doc_id").collect()] == TEXTS + more
