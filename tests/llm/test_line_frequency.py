"""Repeated lines of a host: found where a small part of its documents holds them, and cut at their places."""

from __future__ import annotations

from glyphgate.llm import quality

SCHEMA = "doc_id long, text string, source string, n_chars long"


def words(tag, n):
    return " ".join(f"{tag}x{'abcdefghij'[k % 10]}{k}z" for k in range(n)).translate(str.maketrans("0123456789", "klmnopqrst"))


def test_a_line_in_a_small_part_of_a_host_goes(spark):
    line, passage = "Read our newsletter for more of the same", words("passage", 40)
    rows = [(i, "\n".join([words(f"a{'klmnopqrst'[i // 100]}{'klmnopqrst'[i // 10 % 10]}{'klmnopqrst'[i % 10]}", 25), *["", line.upper() if i % 2 else line, "  "] * (i < 12), words(f"b{i}", 4)]), "hot", 1) for i in range(200)]
    rows += [(300 + i, f"{passage}\n{words('own' + 'klmnopqrst'[i // 10] + 'klmnopqrst'[i % 10], 20)}", "hot", 1) for i in range(11)]
    rows += [(400 + i, f"{words('ten' + 'klmnopqrst'[i], 25)}\nheld by ten documents only", "hot", 1) for i in range(10)]
    rows += [(500 + i, f"{words('alone', 25)}\n{line}", "other", 1) for i in range(30)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    assert {d for d, r in got.items() if r.n_lost_words} == {*range(12), *range(300, 311)}
    assert {d for d, r in got.items() if not r.kept} == set(range(300, 311)) and not any(r.base_failed for r in got.values())
    cleaned = {r.doc_id: r for r in quality.clean(table).collect()}
    for doc, text, _, _ in rows:
        if 300 <= doc < 311:
            assert doc not in cleaned
        else:
            want = "\n".join(x for x in text.split("\n") if doc >= 12 or x.lower() != line.lower())
            assert (cleaned[doc].text, cleaned[doc].n_chars) == (want, len(want))
