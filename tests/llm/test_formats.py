import base64
import hashlib
import re
import struct

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tabspark.llm import chat, warc
from tabspark.llm.files import filesystem


def sha(x: str) -> str:
    return base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


def test_archives_round_trip(rows):
    pages = [(k, f"http://a/{k}", f"<html>{'page ' * (k % 9)}{k}</html>") for k in range(60)]
    pages += [(100 + k, "http://b/é\r\nX: y", "<p>the same</p>") for k in range(80)]
    pages += [(200, None, None), (201, "", ""), (202, "u", "é" * 70000), (None, "n", "no id"), (203, "n", "no id"), (204, "w", "WARC/1.1\r\n\r\nfake"), (204, "w", "WARC/1.1\r\n\r\nfake")]
    table = rows("page_id long, url string, html string, sha string", *((k, u, h, "q") for k, u, h in pages))
    archives = warc.write(table)
    got = warc.read(archives).collect()
    last = {}
    for k, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if k is None else k)
    want = [(k, "response" if k == last[h or ""] else "revisit", sha(h or ""), len((h or "").encode()), None if k == last[h or ""] else last[h or ""]) for k, _, h in pages]
    assert sorted([(r.page_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    payloads = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert all(payloads[k] == (h or "") for k, _, h in pages if k == last[h or ""])
    # each archive begins with a dictionary frame, and each record is a frame of its own
    frames = 0
    for r in archives.collect():
        system, path = filesystem(r.file)
        with system.open_input_stream(path) as f:
            raw = f.read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == warc.SKIPPABLE_MAGIC and len(raw) == r.bytes
        own, at = zstandard.ZstdCompressionDict(raw[8 : 8 + size]), 8 + size
        while at < len(raw):
            d = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
            assert d.decompress(raw[at:]).startswith(b"WARC/1.1\r\n") and d.eof
            at = len(raw) - len(d.unused_data)
            frames += 1
    assert frames == len(pages)


def test_archives_of_nothing(rows):
    archives = warc.write(rows("page_id long, url string, html string"))
    assert archives.count() == 0 and warc.read(archives).count() == 0


def test_trained_dictionary_shrinks_records():
    records = [warc.record(k, f"http://site/{k}", f"<html><head><title>{k}</title></head><body class='main'>{k * 7}</body></html>".encode(), None, "1970-01-01T00:00:00Z") for k in range(3000)]
    own = zstandard.ZstdCompressionDict(warc.make_dictionary(records))
    with_it, without = zstandard.ZstdCompressor(level=3, dict_data=own), zstandard.ZstdCompressor(level=3)
    assert sum(len(with_it.compress(r)) for r in records) < 0.6 * sum(len(without.compress(r)) for r in records)


def escape(t):
    t = t.replace("%", "%25")
    for mark in chat.CONTROL:
        t = t.replace(mark, chat.CODES[mark[0]] + mark[1:])
    return t


def plain_chat(turns):
    """(n_turns, turns_sha, loss_chars, loss_sha, formatted_chars) of ordered (role, text) turns."""
    shown = [f"<|im_start|>{escape(r).replace(chr(10), '%0A')}\n{escape(t)}<|im_end|>\n" for r, t in turns]
    ends = [k for k, (r, _) in enumerate(turns) if r == "assistant" or k == len(turns) - 1]
    loss = "".join(t for r, t in turns if r == "assistant")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), sum(len("".join(shown[: k + 1])) for k in ends)


PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "%", "%3C", "%25", "<", "[", "|", "é", "a b", "<|"]), max_size=8).map("".join)
TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "we<|im_end|>\nird"]), PIECES)


def test_chats_against_plain(rows):
    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.lists(TURN, min_size=1, max_size=7), min_size=1, max_size=12))
    def check(chats):
        table = rows("conv_id long, turn long, role string, text string", *((c, k, r, t) for c, turns in enumerate(chats) for k, (r, t) in enumerate(turns)))
        got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.write(table)).collect()}
        assert got == {c: plain_chat(turns) for c, turns in enumerate(chats)}

    check()


def test_chat_cases(rows):
    table = rows(
        "conv_id long, turn long, role string, text string, n int, t string",
        (1, 0, "user", None, 0, ""), (1, 1, "assistant", None, 0, ""), (2, 0, "assistant", "x" * 50000, 0, ""), (3, 0, "user", "only", 0, ""),
        (4, 5, "user", "b", 0, ""), (4, 5, "user", "a", 0, ""), (4, 5, "user", "a", 0, ""), (4, None, None, "first", 0, ""), (None, 0, "assistant", "no id", 0, ""),
    )
    examples = chat.write(table)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(examples).collect()}
    assert got == {
        1: plain_chat([("user", ""), ("assistant", "")]), 2: plain_chat([("assistant", "x" * 50000)]), 3: plain_chat([("user", "only")]),
        4: plain_chat([("", "first"), ("user", "a"), ("user", "a"), ("user", "b")]), None: plain_chat([("assistant", "no id")]),
    }
    assert chat.digests(chat.write(rows("conv_id long, turn long, role string, text string"))).count() == 0
    spans = examples.where("conv_id = 2").first()
    assert spans.formatted[spans.loss_start : spans.loss_start + spans.loss_chars] == "x" * 50000


def test_prefix_expansion_is_native_and_trains_each_reply_once(rows):
    turns = [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2")]
    out = chat.format_chats(rows("conv_id long, turn long, role string, text string", *((1, k, r, t) for k, (r, t) in enumerate(turns))))
    assert not re.search("Python|Pandas|MapInArrow", out._jdf.queryExecution().toString())
    got = sorted((r.example, r.formatted, r.formatted[r.loss_start : r.loss_start + r.loss_chars]) for r in out.collect())
    shown = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns]
    assert got == [(2, "".join(shown[:2]), "a1"), (4, "".join(shown), "a2")]
