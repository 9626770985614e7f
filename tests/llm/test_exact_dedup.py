from paperloom.llm.exact_dedup import GraceTable, exact_dedup


def test_odd_rows(odd_docs):
    rows = [r.asDict() for r in exact_dedup(odd_docs).collect()]
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["keep_id"] == 1 and by[1]["group_size"] == 1  # case differs
    assert {by[i]["keep_id"] for i in (3, 4, 5)} == {5} and by[3]["group_size"] == 3  # the longest original stays
    assert by[6]["group_size"] == 2 and by[6]["kept"] and by[None]["kept"]


def test_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_spilled_tables_agree(odd_docs):
    want = sorted(map(str, exact_dedup(odd_docs).collect()))
    assert sorted(map(str, exact_dedup(odd_docs, budget=300).collect())) == want


def test_table_compares_contents_of_equal_hashes():
    for budget in (10**9, 250):
        table = GraceTable(budget)
        for i, content in enumerate([b"a", b"b", b"a", b"c" * 100]):
            table.add(5, content, content, 1, i, 1)
        assert sorted((e[1], e[4], e[5]) for e in table.drain()) == [(b"a", 0, 2), (b"b", 1, 1), (b"c" * 100, 3, 1)]
