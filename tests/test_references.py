from folioscope.operators import matching, references
from folioscope.plans.catalog import ROWS_ONLY

NUMBERED = """References
[1] Smith, J., & Doe, A. (2019). Decoding speech from brains. Nature Neuroscience, 12(3), 1-9. https://doi.org/10.1000/abc.1
[2] A. Jones and B. Li, "Attention over voxels," IEEE Trans. Med. Imaging, vol. 3, 2020.
[3] Kim H, Park S, et al. Semantic maps of the cortex. Cell 2018;4:5-9. doi:10.1000/xyz
[12] Smith, J. (2019). Decoding Speech from Brains!
"""


def test_styles():
    n, rows = references.entries(NUMBERED)
    assert n == 3 and [r["title"] for r in rows] == ["Decoding speech from brains", "Attention over voxels", "Semantic maps of the cortex"]
    assert [r["year"] for r in rows] == [2019, 2020, 2018] and [r["doi"] for r in rows] == ["10.1000/abc.1", "", "10.1000/xyz"]
    assert [r["journal"] for r in rows] == ["Nature Neuroscience", "IEEE Trans. Med. Imaging", "Cell"]
    assert [r["authors"] for r in rows] == ["Smith, J., & Doe, A.", "A. Jones and B. Li", "Kim H, Park S, et al."]


def test_splits():
    assert references.split_entries("A one.\nstill one\n\nB two.\n\n") == ["A one. still one", "B two."]
    assert references.split_entries("A one.\nB two.") == ["A one.", "B two."]
    assert references.split_entries("1. A\n2. B\n1. C") == ["1. A", "2. B", "1. C"]  # markers that start over are no list
    assert references.entries(None) == (0, []) == references.entries("\n \n")


def test_bound(monkeypatch):
    monkeypatch.setattr(references, "MOST", 5)
    n, rows = references.entries("\n".join(f"{i}. Author A. (2001). The title of number x{i} here. Journal, 3." for i in range(1, 20)))
    assert n == 19 and len(rows) == 5


def test_query(spark, small):
    got = ROWS_ONLY["j11_references"](spark, small).collect()
    parts = spark.read.parquet(f"{small}/part.parquet").collect()
    assert {(r.key, r.n): r.title for r in got if r.n == 1} == {(str(p.p_partkey), 1): f"On the {p.p_name} number {p.p_partkey}" for p in parts}
    assert all(r.of == 2 and r.year == (1990 if r.n == 1 else 2001) for r in got)
    found = ROWS_ONLY["j12_resolved"](spark, small).collect()
    assert {r.how for r in found} == {"doi", "title"} and all(str(r.place) == r.key.split(":")[0] for r in found)
    assert matching.TITLE_THRESHOLD == 96
