"""Packet captures: Ethernet frames with IPv4 or ARP, decoded per file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import ARP_PROTO, PACKET

# Fixed values of the capture format: magic numbers with byte order and ticks of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
ETHERNET, MAX_CAPTURED = 1, 65536
FLAG_LETTERS = "FSRPAUEC"

_FLAGS = np.array(["".join(letter for bit, letter in enumerate(FLAG_LETTERS) if value >> bit & 1) for value in range(256)], dtype=object)


def dotted(addresses: np.ndarray) -> list[str]:
    """32-bit addresses as dotted quads."""
    known, where = np.unique(addresses, return_inverse=True)
    names = np.array([".".join(str(int(a) >> s & 255) for s in (24, 16, 8, 0)) for a in known], dtype=object)
    return list(names[where]) if len(known) else []


def _frames(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offset, captured length, original length and time of every complete frame."""
    if len(data) < 24:
        raise ValueError("capture header is incomplete")
    if data[:4] not in MAGIC:
        raise ValueError(f"unknown capture magic {data[:4].hex()}")
    order, ticks = MAGIC[data[:4]]
    link = struct.unpack_from(order + "I", data, 20)[0]
    if link != ETHERNET:
        raise ValueError(f"link type {link} is not Ethernet")
    header, rows, at, end = struct.Struct(order + "4I"), [], 24, len(data)
    while at + 16 <= end:
        second, tick, captured, original = header.unpack_from(data, at)
        if captured > MAX_CAPTURED:
            raise ValueError(f"captured length {captured} is too long")
        at += 16
        if at + captured > end:
            break
        rows.append((at, captured, original, second + tick / ticks))
        at += captured
    found = np.array(rows, dtype=[("at", "i8"), ("captured", "i8"), ("original", "i8"), ("time", "f8")])
    return found["at"], found["captured"], found["original"], found["time"]


def decode(data: bytes, arp_compat: bool = False) -> pd.DataFrame:
    """Packets of a capture. ``arp_compat`` takes ARP addresses from the bytes where hardware addresses stand."""
    at, captured, original, time = _frames(data)
    # padded, so that every field of a short frame can be looked at before it is ruled out
    raw = np.frombuffer(data + bytes(128), np.uint8)

    def u8(offset: np.ndarray | int) -> np.ndarray:
        return raw[np.minimum(at + offset, len(raw) - 1)].astype(np.int64)

    def u16(offset: np.ndarray | int) -> np.ndarray:
        return u8(offset) << 8 | u8(offset + 1)

    def u32(offset: np.ndarray | int) -> np.ndarray:
        return u16(offset) << 16 | u16(offset + 2)

    kind = np.where(captured >= 14, u16(12), 0)
    arp = (kind == 0x0806) & (captured >= 42)
    head = (u8(14) & 15) * 4
    proto = u8(23)
    body = 14 + head
    room = captured - body
    tcp, udp, bare = proto == 6, proto == 17, (proto == 1) | (proto == 2)
    ip = (kind == 0x0800) & (captured >= 34) & (u8(14) >> 4 == 4) & (room >= 0) & ((tcp & (room >= 20)) | (udp & (room >= 8)) | bare)
    ported = ip & (tcp | udp)
    sender, target = (22, 32) if arp_compat else (28, 38)
    kept = ip | arp
    out = {
        "timestamp": time,
        "src_ip": np.where(arp, u32(sender), u32(26)),
        "dst_ip": np.where(arp, u32(target), u32(30)),
        "src_port": np.where(ported, u16(body), 0),
        "dst_port": np.where(ported, u16(body + 2), 0),
        "length": original,
        "proto": np.where(arp, ARP_PROTO, proto),
        "ttl": np.where(arp, 0, u8(22)),
        "tcp_flags": np.where(ip & tcp, _FLAGS[u8(body + 13)], ""),
    }
    table = pd.DataFrame({k: v[kept] for k, v in out.items()})
    for side in ("src_ip", "dst_ip"):
        table[side] = dotted(table[side].to_numpy())
    return table.astype({"src_port": "int32", "dst_port": "int32", "length": "int32", "proto": "int32", "ttl": "int16"})


def read_pcap(spark: SparkSession, path: str | list[str], arp_compat: bool = False) -> DataFrame:
    """Packets of capture files, a file per task; a file that can't be read raises."""

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for content in part["content"]:
                yield decode(bytes(content), arp_compat)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, PACKET)


def decode_files(files: DataFrame, arp_compat: bool = False) -> DataFrame:
    """Packets of ``(content, file)`` with ``file`` and ``error``: a capture that can't be read is one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content, file in zip(part["content"], part["file"], strict=True):
                try:
                    yield decode(bytes(content), arp_compat).assign(file=file, error=None)
                except ValueError as e:
                    yield pd.DataFrame([{f.name: None for f in PACKET.fields} | {"file": file, "error": str(e)}])

    schema = T.StructType([*PACKET.fields, T.StructField("file", T.StringType()), T.StructField("error", T.StringType())])
    return files.select("content", "file").mapInPandas(run, schema)
