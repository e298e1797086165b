"""Layers of secrets: every packer inside every other, escapes, data full of false beginnings, and long stretches without a blank."""

import base64
import bz2
import gzip
import lzma
import time
import tracemalloc
import zlib

import pytest

secrets = pytest.importorskip("foliospark.llm.secrets")
zstandard = pytest.importorskip("zstandard")

SECRET = 'token = "abcdEFGH1234ijkl5678"'


def bare(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress, "bzip2": bz2.compress, "xz": lzma.compress, "deflate": bare, "none": lambda data: data}


def wrapped(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("outer", PACKERS)
@pytest.mark.parametrize("inner", PACKERS)
def test_every_packer_inside_every_other(outer, inner):
    text = wrapped(PACKERS[outer](("- " + wrapped(PACKERS[inner](SECRET.encode())) + " -").encode()))
    assert secrets.scan_layers(f"see {text} there") == ([], [(4, 0, 4 + len(text))])


@pytest.mark.parametrize("form", ["%u{:04X}", "%25u{:04x}", "\\U{:08X}", "\\u{:04x}", "%{:02X}", "&#x{:x};"])
def test_escapes(form):
    shown = SECRET.rstrip('"')  # the closing quote is no part of the match
    text = "".join(form.format(ord(c)) for c in shown)
    assert secrets.scan_layers("a " + text)[1] == [(2, 0, 2 + len(text))]


@pytest.mark.parametrize("start", [b"x\x9c", b"\x1f\x8b\x08", b"BZh9", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"])
def test_false_beginnings_take_linear_work(start):
    def took(n):
        text = wrapped(start * n + SECRET.encode())
        began = time.process_time()
        assert [k for _, k, _ in secrets.scan_layers(text)[1]] == [0]
        return time.process_time() - began

    assert took(80_000) < 24 * took(10_000) + 1


def test_long_stretches_without_a_blank_take_bounded_memory(monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 1 << 20)
    pieces = b"q" * (12 << 20) + b' token = "abcdEFGH1234ijkl5678" ' + b"q" * (12 << 20)
    tracemalloc.start()
    assert len(secrets.scan_layers(wrapped(zlib.compress(pieces, 1)))[1]) == 1
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


def test_packed_data_longer_than_a_block_is_found_inside_a_stretch(monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 1 << 18)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 12)
    inner = wrapped(zlib.compress(bytes(range(256)) * 6000 + b" " + SECRET.encode(), 0)).encode()
    text = wrapped(zlib.compress(inner, 1))
    assert [k for _, k, _ in secrets.scan_layers(text)[1]] == [0]
