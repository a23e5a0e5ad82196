"""Where trained models plug in: page layout, recognition, table structure, pictures, speech, chat.

No weights come with the engine. A model is made once in each Python worker by a factory and fed batches; what stands
around it (geometry, decoding, spectra) is in layout.py and here.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillstream.runtime import ship


class PageModel(Protocol):
    def predict(self, images: list[np.ndarray]) -> list[list[dict]]: ...


class ChatModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class EchoChat:
    """A deterministic stand-in: the first passage of the prompt; rewrites are the question and its words turned round."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((line[4:] for line in p.splitlines() if line.startswith("[1] ")), p.rsplit("Question: ", 1)[-1]) for p in prompts]

    def rewrite(self, question: str, n: int = 4) -> list[str]:
        words = question.split()
        return [f"{k + 1}. " + " ".join(words[k % max(len(words), 1) :] + words[: k % max(len(words), 1)]) for k in range(n)]


def complete_column(df: DataFrame, make: Callable[[], ChatModel], *, prompt_col: str = "prompt", out_col: str = "answer") -> DataFrame:
    ship(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in parts:
            yield pdf.assign(**{out_col: model.complete(pdf[prompt_col].tolist())})

    return df.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out_col}` string"]))


def ask_rewrites(chat: ChatModel, question: str, n: int = 4) -> list[str]:
    """n other wordings by a model, the question itself last."""
    p = f"Write {n} other wordings of the question, one a line, and nothing else.\n\nQuestion: {question}"
    lines = chat.rewrite(question, n) if hasattr(chat, "rewrite") else chat.complete([p])[0].splitlines()
    return rewrites("\n".join(lines), question, n)


def ask_hypothetical(chat: ChatModel, question: str) -> str:
    """A passage that would answer the question, by a model; the question where that is blank."""
    return chat.complete([f"Write a short passage that answers the question.\n\nQuestion: {question}"])[0].strip() or question


def rewrites(lines: str, question: str, n: int = 4) -> list[str]:
    """A model's list of rewrites without its markers, the question last; duplicates go."""
    import re

    out = [re.sub(r"^[\d.\-)\s]+", "", x.strip()).strip() for x in lines.splitlines()]
    return [*dict.fromkeys(x for x in out if x and x != question)][:n] + [question]


# Recognition


def ctc_decode(logits: np.ndarray, alphabet: list[str], blank: int = 0) -> tuple[str, float]:
    """Greedy: repeats and blanks go; the mean probability of what stays."""
    e = np.exp(logits - logits.max(-1, keepdims=True))
    p = e / e.sum(-1, keepdims=True)
    best, sure, out, scores = -1, p.max(-1), [], []
    for k, i in enumerate(p.argmax(-1).tolist()):
        if i not in (best, blank):
            out.append(alphabet[i])
            scores.append(float(sure[k]))
        best = i
    return "".join(out), float(np.mean(scores)) if scores else 0.0


def text_lines(img: np.ndarray, ink: float = 128, least: int = 3) -> list[tuple[int, int]]:
    """Rows of a grey page that hold ink, as (top, bottom) runs."""
    rows = np.concatenate([[0], (img < ink).any(1).astype(np.int8), [0]])
    start, end = np.flatnonzero(np.diff(rows) == 1), np.flatnonzero(np.diff(rows) == -1)
    return [(int(a), int(b)) for a, b in zip(start, end) if b - a >= least]


def bilinear(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Half-pixel centres, edges clamped; rounds half up."""
    a = img.astype(np.float64)

    def axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        i = np.floor(x).astype(int)
        return i, np.minimum(i + 1, n - 1), x - i

    y0, y1, fy = axis(a.shape[0], h)
    x0, x1, fx = axis(a.shape[1], w)
    shape = (-1, 1) + (1,) * (a.ndim - 2)
    rows = a[y0] * (1 - fy.reshape((-1,) + (1,) * (a.ndim - 1))) + a[y1] * fy.reshape((-1,) + (1,) * (a.ndim - 1))
    fx = fx.reshape((1,) + shape[:1] + (1,) * (a.ndim - 2)) if a.ndim > 2 else fx
    out = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def crop(img: np.ndarray, box: tuple[float, float, float, float], scale: float = 1.0) -> np.ndarray:
    l, t, r, b = (round(v * scale) for v in box)  # noqa: E741
    return img[max(t, 0) : b, max(l, 0) : r]


# Speech

RATE, FFT, HOP, MELS = 16_000, 400, 160, 80


def decode_wav(data: bytes) -> np.ndarray:
    """PCM of 8, 16 or 32 bits, any channels and rate, to mono at RATE in [-1, 1]."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[width]
    x = np.frombuffer(raw, kind).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(1)
    if rate != RATE and x.size:
        at = np.arange(int(x.size * RATE / rate)) * rate / RATE
        x = np.interp(at, np.arange(x.size), x)
    return x.astype(np.float32)


def mel_filters(mels: int = MELS) -> np.ndarray:
    """Triangles on the Slaney scale, of equal area."""
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    top = 15 + np.log(RATE / 2 / 1000) / (np.log(6.4) / 27)
    edges = to_hz(np.linspace(0, top, mels + 2))
    freq = np.fft.rfftfreq(FFT, 1 / RATE)
    up = (freq - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freq) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray) -> np.ndarray:
    """(MELS, frames): log10 power, floored at 8 below the top, scaled to about [-1, 1]."""
    x = np.pad(x.astype(np.float64), FFT // 2, mode="reflect") if x.size > FFT // 2 else np.pad(x, FFT)
    n = 1 + (x.size - FFT) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(x, FFT)[:: HOP][:n] * np.hanning(FFT + 1)[:-1]
    power = np.abs(np.fft.rfft(frames)) ** 2
    s = np.log10(np.maximum(mel_filters() @ power[:-1].T, 1e-10)) if n > 1 else np.log10(np.maximum(mel_filters() @ power.T, 1e-10))
    return (np.maximum(s, s.max() - 8) + 4) / 4


def segments_text(segments: list[tuple[float, float, str]]) -> list[str]:
    show = lambda v: f"{v:.2f}".rstrip("0").rstrip(".")
    return [f"[time: {show(a)}-{show(b)}] {t.strip()}" for a, b, t in segments if t.strip()]


def interleave(frames: list[float], segments: list[tuple[float, float, str]]) -> list[tuple[str, float, str]]:
    """Frames and transcript by time: a frame no later than a segment's start comes before it, the rest at the end."""
    rows = [(t, 0, "picture", "") for t in frames] + [(a, 1, "text", s) for (a, _, _), s in zip(segments, segments_text(segments))]
    return [(kind, t, s) for t, _, kind, s in sorted(rows)]


def sample_frames(times: list[float], most: int) -> list[float]:
    """At most so many, evenly spread over the sorted times."""
    times = sorted(times)
    return times if len(times) <= most else [times[(2 * k + 1) * len(times) // (2 * most)] for k in range(most)]
