"""The verdict of the secret scan: owners and repositories together."""

import pytest

from merchantscope.llm import secrets

VALUE = "Zk39dQm1x7Rt5Wv2"


def rows_of(docs_of, places):
    """Documents that hold VALUE as a secret, one per (id, owner), and one that holds it bare."""
    rows = [(i, f"token = {VALUE}", owner) for i, owner in places] + [(9_999, f"see {VALUE} there", "elsewhere")]
    return {r.doc_id: r for r in secrets.secret_spans(docs_of(rows)).collect()}


@pytest.mark.parametrize(
    "places, wide, owners, repositories",
    [
        ([(i, "hot") for i in range(500)], True, 1, 500),  # copied inside one source
        ([(i, f"s{i % 2}") for i in range(40)], True, 2, 40),  # twenty for each of two owners
        ([(i, f"s{i % 2}") for i in range(39)], False, 2, 39),
        ([(i, "hot") for i in range(19)], False, 1, 19),
        ([(i, f"s{i}") for i in range(3)], True, 3, 3),  # many owners
        ([(7, "hot")] * 50, False, 1, 1),  # repeated rows are one repository
        ([(None, None)] * 50, False, 1, 1),  # so are unnamed ones
    ],
)
def test_verdict_from_owners_and_repositories(docs_of, places, wide, owners, repositories):
    got = rows_of(docs_of, places)
    for i in {i for i, _ in places}:
        assert (got[i].n_live, got[i].n_example) == ((0, 1) if wide else (1, 0))
        assert (got[i].max_owners, got[i].max_repositories) == (owners, repositories)
    assert [tuple(s)[::2] for s in got[9_999].added] == ([] if wide else [(4, 4 + len(VALUE))])
    assert got[9_999].max_repositories == (0 if wide else repositories)
