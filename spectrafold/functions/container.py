"""Container files: header text, blocks, offset array and a 64-byte trailer."""

from __future__ import annotations

import base64
import json

import numpy as np

TRAILER = 64


def header(info: dict, mode: str) -> bytes:
    """File metadata; ``info`` names omics, parentFile and whatever else is to be kept."""
    info = {**info, "writeFormat": mode}
    if mode == "json":
        return ('{\n "BasicInfo": ' + json.dumps(info) + ",\n").encode()
    return ("BasicInfo: \n" + "".join(f" {k}: {v}\n" for k, v in info.items()) + "\n").encode()


def parse_header(text: str) -> dict:
    if text.startswith("{"):
        body = text[text.index(":") + 1 :].rstrip().rstrip(",")
        return json.loads(body)
    lines = (x.strip() for x in text.split("\n")[1:] if x.strip())
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def trailer(lengths: list[int], mode: str) -> bytes:
    """``lengths``: header, then every block."""
    code = base64.b64encode(np.asarray(lengths, "<u4").tobytes()).decode()
    if mode == "json":
        line = f' "offsetArr": "{code}",\n'
        return (line + f' "offsetLen":{len(line)}'.ljust(TRAILER - 2) + "\n}").encode()
    line = f"offsetArr: {code}\n"
    return (line + f"offsetLen:{len(line)}".ljust(TRAILER - 1) + "\n").encode()


def read_index(f) -> tuple[dict, np.ndarray, np.ndarray]:
    """Header, and start and length of every block, of an open file; raises ValueError for a broken trailer."""
    size = f.seek(0, 2)
    if size < TRAILER:
        raise ValueError("the file is shorter than a container's trailer")
    f.seek(size - TRAILER)
    tail = f.read(TRAILER).decode("ascii", "replace")
    if "offsetLen" not in tail or not (number := tail.partition(":")[2].strip().rstrip("}").strip()).isdigit():
        raise ValueError("the container's trailer is broken")
    n = int(number)
    if n > size - TRAILER:
        raise ValueError("the container's offset array is broken")
    f.seek(size - TRAILER - n)
    line = f.read(n).decode("ascii", "replace")
    try:
        lengths = np.frombuffer(base64.b64decode(line.partition(":")[2].strip().strip('",').strip(), validate=True), "<u4").astype(np.int64)
    except ValueError:
        raise ValueError("the container's offset array is broken") from None
    if not len(lengths) or lengths.sum() != size - TRAILER - n:
        raise ValueError("the container's offsets don't add up to its size")
    f.seek(0)
    info = parse_header(f.read(int(lengths[0])).decode())
    return info, np.cumsum(lengths)[:-1], lengths[1:]
