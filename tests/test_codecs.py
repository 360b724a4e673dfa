import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrafold.functions import blocks as B
from spectrafold.functions import codecs as C

quick = settings(max_examples=60, deadline=None)


@quick
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_elias_fano_round_trip(values):
    x = np.sort(np.array(values, np.uint64))
    for word in (32, 64):
        assert (C.ef_decode(C.ef_encode(x, word), word) == x).all()


@pytest.mark.parametrize("x", [[], [0], [5], [7] * 100, list(range(1000)), [2**32 - 1], list(range(0, 4096, 4)), [0] * 5 + [2**31]])
def test_elias_fano_cases(x):
    code = C.ef_encode(x)
    assert C.ef_decode(code).tolist() == x
    if x:
        words = np.frombuffer(code, "<u4")
        width = C.low_bits(len(x), x[-1])
        assert words[-2] == len(x) and words[-1] % 100 == width
        assert len(words) - 2 == -(-len(x) * (width + 2) // 32)
        assert width == (0 if x[-1] <= len(x) else int(np.ceil(np.log2(x[-1] / len(x)))))


def test_elias_fano_needs_order():
    with pytest.raises(ValueError):
        C.ef_encode([3, 2])


@quick
@given(st.text("ATGCNatgcRYK", max_size=70))
def test_two_bit_round_trip(s):
    packed, other, letters = C.pack_bases(s.encode())
    assert len(packed) == -(-len(s) // 4)
    assert C.unpack_bases(packed, len(s), other, letters).decode() == s


@quick
@given(st.text('FF:,"#!I', max_size=200))
def test_quality_round_trip(s):
    assert C.decode_quality(*C.encode_quality(s.encode())).decode() == s


def test_quality_keeps_the_last_run_and_single_symbols():
    for s in ("A", "AAAA", "AB", "AAB" * 50, "B" + "A" * 1000):
        assert C.decode_quality(*C.encode_quality(s.encode())).decode() == s


@quick
@given(st.lists(st.text("a1:0 \t", max_size=8), min_size=1, max_size=20))
def test_identifiers_round_trip(ids):
    key, code = C.encode_ids(ids)
    assert C.decode_ids(json.loads(json.dumps(key)), code, len(ids)) == ids


def test_identifier_columns():
    ids = [f"@A00:12:HX:{k}:0{k % 3} 1:N" for k in range(600)]
    key, code = C.encode_ids(ids)
    assert [k[0] for k in key] == ["c", "c", "c", "n", "d", "c", "c", "c"]
    assert C.decode_ids(key, code, 600) == ids and len(code) < 4 * 600


@pytest.mark.parametrize("mode", B.MODES)
@pytest.mark.parametrize("n", [1, 511, 512, 513])
def test_reads_block(mode, n):
    rng = np.random.default_rng(n)
    seq = ["".join(rng.choice(list("ATGCN"), rng.integers(0, 9))) for _ in range(n)]
    qual = ["".join(rng.choice(list('F:,"#'), len(s))) for s in seq]
    ids = [f"@r:{k}" for k in range(n)]
    got = B.decode_reads(B.encode_reads(1024, ids, seq, qual, mode), mode)
    assert [(r["read_id"], r["identifier"], r["sequence"], r["quality"]) for r in got] == [(1024 + k, ids[k], seq[k], qual[k]) for k in range(n)]


@pytest.mark.parametrize("mode", B.MODES)
@pytest.mark.parametrize("mobility", [None, [3, 1, 2]])
@pytest.mark.parametrize("precision", [0.001, 0.0001])
def test_scan_block(mode, mobility, precision):
    scan = {"scan_index": 9, "rt": 1.5, "ms_level": 2, "charge": None, "precursor_mz": None, "collision_energy": 25.0, "mz": [300.12345, 100.5, 200.0], "intensity": [4e7, 2.0, 0.5], "mobility_index": mobility}
    got = B.decode_scan(B.encode_scan(scan, mode, precision), mode, precision)
    assert [got[k] for k in ("scan_index", "rt", "ms_level", "charge", "precursor_mz", "collision_energy")] == [9, 1.5, 2, None, None, 25.0]
    order = np.argsort(scan["mz"])
    assert np.abs(np.array(got["mz"]) - np.array(scan["mz"])[order]).max() <= precision / 2 + 1e-9
    assert np.abs(np.sqrt(got["intensity"]) - np.sqrt(np.array(scan["intensity"])[order])).max() <= 0.5
    assert got["mobility_index"] == ([mobility[k] for k in order] if mobility else [])


def test_scan_sums_stay_exact_beyond_float32():
    scan = {"scan_index": 0, "rt": 0.0, "ms_level": 1, "mz": list(range(1, 3001)), "intensity": [1e8 + k for k in range(3000)]}
    got = B.decode_scan(B.encode_scan(scan))
    assert np.abs(np.sqrt(got["intensity"]) - np.sqrt(scan["intensity"])).max() <= 0.5


@pytest.mark.parametrize("mode", B.MODES)
@pytest.mark.parametrize("continuous", [False, True])
def test_spectrum_block(mode, continuous):
    s = {"spectrum_id": 4, "pos_x": 1.0, "pos_y": 2.0, "pos_3dx": None, "pos_3dy": None, "pos_3dz": None, "mz": [100.5, 200.25], "intensity": [0.5, 7.25]}
    got = B.decode_spectrum(B.encode_spectrum(s, mode, continuous), mode, continuous)
    assert got["pos_x"] == 1.0 and got["pos_3dz"] is None and got["spectrum_id"] == 4
    assert got["mz"] == ([] if continuous else [100.5, 200.25])
    assert np.abs(np.array(got["intensity"]) - [0.5, 7.25]).max() <= (0.03 if continuous else 1e-5)


def test_values_out_of_range_raise():
    with pytest.raises(ValueError):
        B.encode_scan({"scan_index": 0, "mz": [5e9], "intensity": [1.0]})
