"""Container blocks: one scan, one imaging spectrum or one batch of reads, as binary, JSON or YAML."""

from __future__ import annotations

import base64
import json
import re
import struct

import numpy as np

from . import codecs as C
from .columns import mz_steps

# Fixed layouts of binary blocks, little-endian.
SCAN = struct.Struct("<3f6I")
SPECTRUM = struct.Struct("<6f3I")
READS = struct.Struct("<8I")
MODES = ("binary", "json", "yaml")


def _b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def _text(title: str, fields: dict, mode: str) -> bytes:
    if mode == "json":
        return (json.dumps(title) + ": " + json.dumps(fields) + "\n").encode()
    return (title + ":\n" + "".join(f" {k}: {json.dumps(v) if isinstance(v, list) else v}\n" for k, v in fields.items()) + "\n").encode()


def _fields(block: bytes, mode: str) -> tuple[str, dict]:
    text = block.decode()
    if mode == "json":
        title, body = re.match(r'"([^"]*)": (.*)', text, re.S).groups()
        return title, json.loads(body.strip().rstrip(","))
    lines = text.split("\n")
    pairs = (x.partition(":") for x in lines[1:] if x.strip())
    return lines[0].rstrip(":"), {k.strip(): v.strip() for k, _, v in pairs}


def _quantize(values: np.ndarray, factor: float) -> np.ndarray:
    """Half away from zero; values are not negative.  What isn't a number has no code and is an error."""
    x = np.asarray(values, float)
    if not np.isfinite(x).all():
        raise ValueError("a value isn't a finite number, which the block's integers can't hold")
    return np.floor(x * factor + 0.5).astype(np.int64)


def _root(values: np.ndarray) -> np.ndarray:
    if (values < 0).any():
        raise ValueError("an intensity is negative")
    return np.sqrt(values)


def _mz_code(mz: np.ndarray, precision: float) -> np.ndarray:
    step, whole = mz_steps(precision)
    return _quantize(mz if whole else np.asarray(mz, float) / step, step if whole else 1.0)


def _mz_value(q: np.ndarray, precision: float) -> np.ndarray:
    step, whole = mz_steps(precision)
    return q / step if whole else q * step


def _listed(fields: dict) -> dict:
    return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in fields.items()}


def _checked(q: np.ndarray, word: int) -> np.ndarray:
    if len(q) and (q.min() < 0 or q.max() >= 1 << word):
        raise ValueError(f"a value leaves the range of {word}-bit unsigned integers")
    return q


def encode_scan(scan: dict, mode: str = "binary", precision: float = 0.001, mobility: bool = True) -> bytes:
    """A proteomics scan: peaks are ordered by (mz, mobility, intensity), m/z kept to ``precision``, intensity to a whole square root."""
    mz, inten = np.asarray(scan["mz"], float), np.asarray(scan["intensity"], float)
    mob = scan.get("mobility_index")
    mob = np.asarray(mob, np.int64) if mobility and mob is not None and len(mob) else None
    order = np.lexsort((inten, mob if mob is not None else np.zeros(len(mz)), mz))
    code_mz = C.zstd(C.ef_encode(_checked(_mz_code(mz[order], precision), 32), 32))
    code_int = C.zstd(C.ef_encode(np.cumsum(_quantize(_root(inten[order]), 1)), 64))
    code_mob = C.zstd(C.ef_encode(_checked(np.cumsum(mob[order]), 32), 32)) if mob is not None else b""
    number = lambda k: -1.0 if scan.get(k) is None else float(scan[k])
    whole = lambda k: int(scan.get(k) or 0)
    if mode == "binary":
        head = SCAN.pack(number("rt"), number("precursor_mz"), number("collision_energy"), whole("scan_index"), whole("ms_level"), whole("charge"), len(code_mz), len(code_int), len(code_mob))
        return head + code_mz + code_int + code_mob
    fields = {"rt": number("rt"), "precursorMz": number("precursor_mz"), "collisionEnergy": number("collision_energy"), "scanIndex": whole("scan_index"), "msLevel": whole("ms_level"), "charge": whole("charge"), "mz": _b64(code_mz), "intensity": _b64(code_int), "mobility": _b64(code_mob)}
    return _text(f"scan_{whole('scan_index')}", fields, mode)


def decode_scan(block: bytes, mode: str = "binary", precision: float = 0.001, columns: list[str] | None = None) -> dict:
    """The scan's fields; arrays that aren't among ``columns`` stay None."""
    return _listed(scan_arrays(block, mode, precision, columns))


def scan_arrays(block: bytes, mode: str = "binary", precision: float = 0.001, columns: list[str] | None = None) -> dict:
    """As decode_scan, with arrays instead of lists."""
    wanted = lambda name: columns is None or name in columns
    if mode == "binary":
        rt, precursor, energy, index, level, charge, *sizes = SCAN.unpack_from(block)
        cut = np.cumsum([SCAN.size, *sizes])
        codes = [block[a:b] for a, b in zip(cut, cut[1:])]
    else:
        _, f = _fields(block, mode)
        rt, precursor, energy, index, level, charge = float(f["rt"]), float(f["precursorMz"]), float(f["collisionEnergy"]), int(f["scanIndex"]), int(f["msLevel"]), int(f["charge"])
        codes = [base64.b64decode(f[k]) for k in ("mz", "intensity", "mobility")]
    mz = _mz_value(C.ef_decode(C.unzstd(codes[0]), 32), precision) if wanted("mz") else None
    inten = C.delta(C.ef_decode(C.unzstd(codes[1]), 64)).astype(float) ** 2 if wanted("intensity") else None
    mob = None
    if wanted("mobility_index"):
        mob = C.delta(C.ef_decode(C.unzstd(codes[2]), 32)) if codes[2] else np.zeros(0, np.int64)
    absent = lambda v: None if v == -1.0 else v
    return {"scan_index": index, "rt": rt, "ms_level": level, "charge": charge or None, "precursor_mz": absent(precursor), "collision_energy": absent(energy), "mz": mz, "intensity": inten, "mobility_index": mob}


def encode_spectrum(s: dict, mode: str = "binary", continuous: bool = False, precision: float = 0.001) -> bytes:
    """An imaging spectrum.  Continuous files share their m/z axis and keep round(sqrt((i - min) * 1e4)); processed ones keep m/z and round((i - min) * 1e5)."""
    inten = np.asarray(s["intensity"], float)
    floor = float(np.float32(inten.min())) if len(inten) else 0.0
    rest = np.maximum(inten - floor, 0)
    values = _quantize(np.sqrt(rest * 1e4), 1) if continuous else _quantize(rest, 1e5)
    code_int = C.zstd(C.ef_encode(np.cumsum(values), 64))
    code_mz = b"" if continuous else C.zstd(C.ef_encode(_checked(_mz_code(s["mz"], precision), 32), 32))
    place = [float("nan") if s.get(k) is None else float(s[k]) for k in ("pos_x", "pos_y", "pos_3dx", "pos_3dy", "pos_3dz")]
    if mode == "binary":
        return SPECTRUM.pack(*place, floor, int(s["spectrum_id"]), len(code_int), len(code_mz)) + code_int + code_mz
    fields = dict(zip(("positionX", "positionY", "3DPositionX", "3DPositionY", "3DPositionZ"), ["NA" if v != v else v for v in place])) | {"minIntensity": floor, "spectrumId": int(s["spectrum_id"]), "intensity": _b64(code_int), "mz": _b64(code_mz)}
    return _text(f"spectrum_{int(s['spectrum_id'])}", fields, mode)


def decode_spectrum(block: bytes, mode: str = "binary", continuous: bool = False, precision: float = 0.001, columns: list[str] | None = None) -> dict:
    """The spectrum's fields; arrays that aren't among ``columns`` stay None."""
    return _listed(spectrum_arrays(block, mode, continuous, precision, columns))


def spectrum_arrays(block: bytes, mode: str = "binary", continuous: bool = False, precision: float = 0.001, columns: list[str] | None = None) -> dict:
    """As decode_spectrum, with arrays instead of lists."""
    wanted = lambda name: columns is None or name in columns
    if mode == "binary":
        *place, floor, index, n_int, n_mz = SPECTRUM.unpack_from(block)
        code_int = block[SPECTRUM.size : SPECTRUM.size + n_int]
        code_mz = block[SPECTRUM.size + n_int : SPECTRUM.size + n_int + n_mz]
    else:
        _, f = _fields(block, mode)
        place = [float("nan") if f[k] == "NA" else float(f[k]) for k in ("positionX", "positionY", "3DPositionX", "3DPositionY", "3DPositionZ")]
        floor, index = float(f["minIntensity"]), int(f["spectrumId"])
        code_int, code_mz = base64.b64decode(f["intensity"]), base64.b64decode(f["mz"])
    inten = mz = None
    if wanted("intensity"):
        d = C.delta(C.ef_decode(C.unzstd(code_int), 64)).astype(float)
        inten = d**2 * 1e-4 + floor if continuous else d * 1e-5 + floor
    if wanted("mz"):
        mz = _mz_value(C.ef_decode(C.unzstd(code_mz), 32), precision) if code_mz else np.zeros(0)
    out = dict(zip(("pos_x", "pos_y", "pos_3dx", "pos_3dy", "pos_3dz"), [None if v != v else v for v in place]))
    return out | {"spectrum_id": index, "intensity": inten, "mz": mz}


def encode_reads(first: int, identifiers: list[str], sequences: list[str], qualities: list[str], mode: str = "binary") -> bytes:
    """A batch of reads with consecutive ids from ``first``; all lines are restored exactly, of any lengths."""
    key, values = C.encode_ids(identifiers)
    raw = [s.encode() for s in sequences]
    packed, other, letters = C.pack_bases(b"".join(raw))
    alphabet, quality = C.encode_quality("".join(qualities).encode("latin-1"))
    extra = {"lengths": [len(s) for s in raw], "quality_lengths": [len(q) for q in qualities]}
    for k, x in extra.items():
        extra[k] = x[0] if len(set(x)) == 1 else x
    text = json.dumps({"ids": key, "letters": letters.decode(), **extra}, separators=(",", ":"))
    last = first + len(identifiers) - 1
    parts = [text.encode(), values, C.zstd(packed), other.tobytes(), alphabet, quality]
    if mode == "binary":
        return READS.pack(first, last, *map(len, parts)) + b"".join(parts)
    names = ("idKey", "idValue", "sequence", "npos", "qKey", "qValue")
    return _text(f"read_{first}-{last}", dict(zip(names, map(_b64, parts))), mode)


def decode_reads(block: bytes, mode: str = "binary") -> list[dict]:
    if mode == "binary":
        first, last, *sizes = READS.unpack_from(block)
        cut = np.cumsum([READS.size, *sizes])
        parts = [block[a:b] for a, b in zip(cut, cut[1:])]
    else:
        title, f = _fields(block, mode)
        first, last = map(int, re.fullmatch(r"read_(\d+)-(\d+)", title).groups())
        parts = [base64.b64decode(f[k]) for k in ("idKey", "idValue", "sequence", "npos", "qKey", "qValue")]
    text, n = json.loads(parts[0]), last - first + 1
    ids = C.decode_ids(text["ids"], parts[1], n)
    sizes = [text[k] if isinstance(text[k], list) else [text[k]] * n for k in ("lengths", "quality_lengths")]
    sequence = C.unpack_bases(C.unzstd(parts[2]), sum(sizes[0]), np.frombuffer(parts[3], "<u4"), text["letters"].encode())
    quality = C.decode_quality(parts[4], parts[5]).decode("latin-1")
    out, a, b = [], 0, 0
    for k in range(n):
        x, y = sizes[0][k], sizes[1][k]
        out.append({"read_id": first + k, "identifier": ids[k], "sequence": sequence[a : a + x].decode(), "quality": quality[b : b + y]})
        a, b = a + x, b + y
    return out
