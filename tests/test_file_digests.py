"""Files of any size: piecewise SHA-256 and segmented BLAKE3 equal the
whole-file digests, for empty, one-chunk and multi-segment files."""

import hashlib
import tempfile

import pytest

from provenant.functions.blake3 import blake3_hex
from provenant.plans.catalog import QUERIES
from provenant.plans.fixtures import table
from provenant.sources.file_digests import file_digests

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def files():
    tmp = tempfile.mkdtemp(prefix="provenant-fd-")
    out = {}
    for name, n in [("empty", 0), ("one", 1), ("chunk", 1024), ("chunk1", 1025), ("mid", 5000),
                    ("big", 70 * 1024 + 5), ("many", 2100 * 1024 + 3)]:
        data = bytes((i * 7 + n) % 251 for i in range(n))
        with open(f"{tmp}/{name}", "wb") as f:
            f.write(data)
        out[f"{tmp}/{name}"] = data
    return tmp, out


@pytest.mark.parametrize("algorithm,segment", [("sha256", 1 << 26), ("blake3", 1 << 26), ("blake3", 4096),
                                               ("blake3", 1024)])
def test_piecewise_equals_whole(spark, files, algorithm, segment):
    tmp, data = files
    paths = spark.createDataFrame([(p,) for p in data] + [(f"{tmp}/missing",)], "path string")
    got = {r.path: r for r in file_digests(paths, algorithm, segment).collect()}
    for p, d in data.items():
        want = hashlib.sha256(d).hexdigest() if algorithm == "sha256" else blake3_hex([d])[0]
        assert (got[p].size, got[p].data_digest) == (len(d), want), p
    assert got[f"{tmp}/missing"].exists is False and got[f"{tmp}/missing"].data_digest is None


def test_query_matches_whole_text_blake3(spark):
    got = {r.doc_id: r.data_digest for r in QUERIES["file_digests_blake3"](spark, SF_SMALL).collect()}
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], blake3_hex([(d.text + "\n").encode() for d in docs])))
    assert got == want
