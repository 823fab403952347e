"""MPEG transport streams as a media column: written, stored and parsed back.

A payload is carried in PES packets of one private stream, with a presentation time each, behind a
program association and a program map table that are repeated at every random access point.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import stored

#: Fixed values of the format: packet size, sync byte, start of a PES packet of private stream 1, packet id of stuffing.
PACKET, SYNC, PES_START, NULL_PID = 188, 0x47, b"\x00\x00\x01\xbd", 0x1FFF
#: This writer's choices: packet ids, stream type (private PES data), bytes a PES packet, ticks between them, PES packets between access points.
PMT_PID, ES_PID, STREAM_TYPE, PES_BYTES, TICKS, EVERY = 0x100, 0x101, 0x06, 192 * 160, 3003, 4
UNIT = 192


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: polynomial 04C11DB7, no reflection."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255, 1 | t << 1 & 254])


def mux(payload: bytes) -> bytes:
    """The transport stream that carries a payload of at least one byte."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        ticks, access = k * TICKS, k % EVERY == 0
        if access:
            out += [_table_packet(0, PAT, tables), _table_packet(PMT_PID, PMT, tables)]
            tables += 1
        data = payload[at : at + PES_BYTES]
        pes = PES_START + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + data
        # an access point's first packet has an adaptation field with the flag and the clock
        first = b"\x07\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big") if access else b""
        room = PACKET - 4 - len(first)
        full, rest = divmod(max(0, len(pes) - room), PACKET - 4)
        n = 1 + full + (rest > 0)
        block = np.full((n, PACKET), 0xFF, np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        block[0, 1] |= 0x40
        counter += n
        raw = np.frombuffer(pes, np.uint8)

        def stuffed(i: int, field: bytes, part: np.ndarray) -> None:
            """A packet whose adaptation field, lengthened by stuffing, and data fill it."""
            space = PACKET - 4 - len(part)
            if space:
                field = (field or (b"\x00" if space == 1 else b"\x00\x00"))[:space]
                field = bytes([space - 1]) + field[1:]
                block[i, 3] |= 0x20
                block[i, 4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
            block[i, PACKET - len(part) :] = part

        stuffed(0, first, raw[:room])
        if full:
            block[1 : 1 + full, 4:] = raw[room : room + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if rest:
            stuffed(n - 1, b"", raw[len(raw) - rest :])
        out.append(block.tobytes())
    return b"".join(out)


class StreamError(ValueError):
    pass


def _sections(units: list[tuple[bool, bytes]]) -> list[bytes]:
    """The whole table sections in the payloads of one packet id (whether a section begins in it, bytes), also sections over
    several packets and several in one; their checksums checked."""
    out, held = [], b""
    for begins, data in units:
        if begins and (not data or data[0] >= len(data)):
            raise StreamError("a table section is damaged")
        going = held + (data[1 : 1 + data[0]] if begins else data) if held else b""
        for more in (going, data[1 + data[0] :]) if begins else (going,):
            while len(more) >= 3 and more[0] != 0xFF and len(more) >= (size := 3 + (int.from_bytes(more[1:3], "big") & 0xFFF)):
                if crc32_mpeg(more[:size]):
                    raise StreamError("a table section is damaged")
                out.append(more[:size])
                more = more[size:]
            held = b"" if not more or more[0] == 0xFF else more
    return out


def _stamped(s: bytes) -> int:
    return (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1


def demux(stream: bytes, program: int | None = None) -> tuple[bytes, dict]:
    """The payload of a program's first elementary stream and what the stream says of itself.

    ``packets, programs, pid, stream_type, pes, pts`` (all times), ``access`` (pairs of PES number and time
    at random access points), ``lost``: breaks in a packet id's continuity counter, ``duplicates``: packets sent twice, which
    count once, ``streams``: packet id and type of all elementary streams by program number. ``program``: its number; the first one
    if not given. A break announced by the discontinuity flag isn't lost. Raises StreamError on
    lost sync, on tables that are missing or damaged and on PES packets with a part missing.
    """
    if len(stream) % PACKET or not stream:
        raise StreamError("not a whole number of packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise StreamError("lost sync")
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    unit, has_field, has_data, counter = p[:, 1] & 0x40 > 0, p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0, (p[:, 3] & 15).astype(np.int64)
    start = np.where(has_field, 5 + p[:, 4].astype(np.int64), 4)
    flags = np.where(has_field & (p[:, 4] > 0), p[:, 5], 0)
    random_access, jump = flags & 0x40 > 0, flags & 0x80 > 0
    lost, duplicate, broken = 0, np.zeros(len(p), bool), np.zeros(len(p), bool)
    for x in np.unique(pid).tolist():
        if x == NULL_PID:
            continue
        at = np.flatnonzero((pid == x) & has_data)
        step = (counter[at[1:]] - counter[at[:-1]]) % 16
        # a packet may be sent twice in a row: equal but for its clock
        again = np.zeros(len(at), bool)
        for k in np.flatnonzero(step == 0).tolist():
            a, b = p[at[k]], p[at[k + 1]]
            again[k + 1] = not again[k] and start[at[k]] == start[at[k + 1]] and bool((a[start[at[k]] :] == b[start[at[k]] :]).all())
        duplicate[at] = again
        kept = at[~again]
        gap = ((counter[kept[1:]] - counter[kept[:-1]]) % 16 != 1) & ~jump[kept[1:]]
        broken[kept[1:][gap]] = True
        lost += int(gap.sum())

    def sections(x: int) -> list[bytes]:
        return _sections([(bool(unit[i]), p[i, start[i] :].tobytes()) for i in np.flatnonzero((pid == x) & has_data & ~duplicate).tolist()])

    programs: dict[int, int] = {}
    for pat in sections(0):
        if pat[0] == 0:
            for i in range(8, len(pat) - 4, 4):
                if number := int.from_bytes(pat[i : i + 2], "big"):
                    programs.setdefault(number, int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF)
    if not programs:
        raise StreamError("no program association table")
    streams: dict[int, list[tuple[int, int]]] = {}
    for number, table in programs.items():
        pmt = next((x for x in sections(table) if x[0] == 2 and int.from_bytes(x[3:5], "big") == number), None)
        if pmt is None:
            raise StreamError("no program map table")
        i, streams[number] = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF), []
        while i < len(pmt) - 4:
            streams[number].append((int.from_bytes(pmt[i + 1 : i + 3], "big") & 0x1FFF, pmt[i]))
            i += 5 + (int.from_bytes(pmt[i + 3 : i + 5], "big") & 0xFFF)
    own = streams.get(next(iter(programs)) if program is None else program)
    if not own:
        raise StreamError("no such program, or nothing in it")
    es, kind = own[0]
    mine = np.flatnonzero((pid == es) & has_data & ~duplicate)
    mine = mine[np.cumsum(unit[mine]) > 0]  # what precedes the first PES packet belongs to none
    data = p[mine][np.arange(PACKET) >= start[mine, None]].tobytes()
    ends = np.cumsum(PACKET - np.minimum(start[mine], PACKET))
    first = np.flatnonzero(unit[mine])
    begins = (ends - (PACKET - np.minimum(start[mine], PACKET)))[first].tolist()
    flagged = random_access[mine][first].tolist()
    torn = np.add.reduceat((broken[mine] & ~unit[mine]).astype(np.int64), first) if len(first) else []
    parts, pts, access = [], [], []
    for k, (b, e) in enumerate(zip(begins, [*begins[1:], len(data)])):
        pes = data[b:e]
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != PES_START[:3] or len(pes) < 9 or size and len(pes) < 6 + size or torn[k]:
            raise StreamError("a PES packet is damaged")
        t = _stamped(pes[9:14]) if pes[7] & 0x80 else None
        pts.append(t)
        if flagged[k]:
            access.append((k, t))
        parts.append(pes[9 + pes[8] : 6 + size if size else None])
    return b"".join(parts), {"packets": len(p), "programs": len(programs), "pid": es, "stream_type": kind, "pes": len(parts), "pts": pts, "access": access, "lost": lost, "duplicates": int(duplicate.sum()), "streams": streams}


def pad(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and these with blanks up to a positive multiple of UNIT."""
    raw = text.encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: a transport stream per row. Null texts count as empty."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            names = pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for b in range(0, len(pdf), 500):
                padded = [pad(t) for t in pdf["text"].iloc[b : b + 500].fillna("")]
                yield pd.DataFrame({"doc_id": names[b : b + 500], "n_bytes": [n for n, _ in padded], "media": [mux(x) for _, x in padded]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def parse_media(media: DataFrame) -> DataFrame:
    """Every row's stream taken apart: payload digests, times, access points, ``feature``.

    ``pts array<long>``, ``access_points array<struct<pes:int,pts:long>>`` and ``lost`` hold the timestamps,
    random access points and continuity breaks.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, access_points array<struct<pes:int,pts:long>>, lost long"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            names = pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for name, n, media in zip(names, pdf["n_bytes"], pdf["media"]):
                payload, info = demux(media)
                points = "/".join(f"{k}@{t}" for k, t in info["access"])
                feature = f"packets={info['packets']};programs={info['programs']};pid={info['pid']};type={info['stream_type']};pes={info['pes']};pts={info['pts'][0]}-{info['pts'][-1]};access={points};lost={info['lost']}"
                rows.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, info["pts"], [{"pes": k, "pts": t} for k, t in info["access"]], info["lost"]))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text as a transport stream, read the stored bytes back and describe them.

    Narrow passes around one Parquet table in the shared folder; nothing is shuffled. Null texts count
    as empty (one block of blanks); repeated rows stay; equal texts give equal values. An empty table
    gives an empty result.
    """
    return parse_media(stored(to_media(docs), "media"))
