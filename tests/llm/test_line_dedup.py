from cadenza.llm.line_dedup import SPACE, UPPER, LOWER, dedup_lines

LOW = str.maketrans(UPPER, LOWER)


def brute(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(SPACE).translate(LOW)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        for chars, n in ((40, 5), (10, 2)):
            got = dedup_lines(table, min_chars=chars, min_docs=n)
            assert set(got.columns) == {*table.columns, "n_lines", "n_dropped"}
            found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str)
            assert found == brute(rows, chars, n)
    assert any(x[2] for x in brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert dedup_lines(no_docs).count() == 0
