"""Payload bytes in plain Python: packing, restoring, and bodies that are not whole."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators import payload


@pytest.mark.parametrize("width", [4, 6, 8])
@pytest.mark.parametrize("n", [1, 3, 7, 8, 17, 256, 4097])
def test_codes_come_back(width, n):
    codes = np.random.default_rng(n).integers(0, 1 << width, n).astype(np.int32)
    data = payload.pack(codes, width)
    assert len(data) == (n * width + 7) // 8 and (payload.unpack(data, width, n) == codes).all()


def test_raw_elements_keep_their_bits():
    x = np.array([0.0, -0.0, 1.5, np.inf, -np.inf, np.nan], np.float32)
    for dtype in ("bf16", "fp16", "fp32"):
        assert payload.from_raw(payload.raw_bytes(x, dtype), dtype).tobytes() == x.tobytes()


def test_bodies_that_are_not_whole_are_refused():
    x = np.arange(300, dtype=np.float32)
    body = payload._group_record(0, 0.0, 0.0, x[:256], x[:256], "fp32") + payload._group_record(8, 256.0, 0.5, np.arange(44, dtype=np.int32) * 2, x[256:], "fp32")
    assert (payload.decode_body(body, "blockwise", "fp32", [300], 256, 2) == x).all()
    for bad in (body[:-1], body + b"\0", b"\x05" + body[1:], b""):
        with pytest.raises(ValueError):
            payload.decode_body(bad, "blockwise", "fp32", [300], 256, 2)
    assert (payload.decode_body(x.tobytes(), "blockwise", "fp32", [300], 256, 0) == x).all()
    with pytest.raises(ValueError):
        payload.decode_body(x.tobytes()[:-4], "blockwise", "fp32", [300], 256, 0)
