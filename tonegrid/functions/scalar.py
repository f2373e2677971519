"""Scalar expressions of signal analysis, as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note names, file extensions of each audio format.
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}
FORMATS = {"Wav": ("wav", "wave"), "Mp3": ("mp3",), "Flac": ("flac",), "Ogg": ("ogg", "oga"), "M4a": ("m4a", "aac")}

#: What a silent level counts as, and the floor of logarithms.
DB_EPSILON = 1e-10
LUFS_OFFSET = -0.691
LUFS_FLOOR = -70.0


def col(x: str | Column | float) -> Column:
    """A column by name, a column, or a number."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def to_db(x: str | Column) -> Column:
    """Decibels of a magnitude; silence is -200."""
    return F.lit(20.0) * F.log10(col(x) + F.lit(DB_EPSILON))


def level_db(x: Column, silent: float) -> Column:
    """Decibels of a positive level, ``silent`` where there is none."""
    return F.when(x > 0, F.lit(20.0) * F.log10(x)).otherwise(F.lit(silent))


def lufs(mean_square: Column) -> Column:
    return F.lit(LUFS_OFFSET) + F.lit(10.0) * F.log10(mean_square)


def power_of_lufs(level: float) -> float:
    return 10.0 ** ((level - LUFS_OFFSET) / 10.0)


def hz_to_mel(hz: str | Column) -> Column:
    return F.lit(2595.0) * F.log10(F.lit(1.0) + col(hz) / F.lit(700.0))


def mel_to_hz(mel: str | Column) -> Column:
    return F.lit(700.0) * (F.pow(F.lit(10.0), col(mel) / F.lit(2595.0)) - F.lit(1.0))


def hz_to_midi(hz: str | Column) -> Column:
    """Fractional MIDI note; null for a frequency of 0 or less."""
    hz = col(hz)
    return F.when(hz > 0, F.lit(69.0) + F.lit(12.0) * F.log2(hz / F.lit(440.0)))


def nearest(x: Column) -> Column:
    """Rounded half away from zero, as a long."""
    return F.round(x).cast("long")


def midi_note(hz: str | Column) -> Column:
    """The nearest MIDI note within 0..255, null without a frequency."""
    return F.least(F.greatest(nearest(hz_to_midi(hz)), F.lit(0)), F.lit(255)).cast("int")


def note_name(midi: str | Column) -> Column:
    """``A4`` for 69."""
    midi = col(midi)
    names = F.array(*[F.lit(n) for n in NOTES])
    octave = F.floor(midi / 12) - 1
    return F.concat(F.element_at(names, (F.pmod(midi, F.lit(12)) + 1).cast("int")), octave.cast("string"))


def cents_offset(hz: str | Column) -> Column:
    midi = hz_to_midi(hz)
    return (midi - F.round(midi)) * 100


def pitch_class(hz: str | Column) -> Column:
    """0 for C to 11 for B, of the nearest note."""
    return F.pmod(nearest(hz_to_midi(hz)), F.lit(12)).cast("int")


def note_index(name: str | Column) -> Column:
    """Pitch class of a note name, flats too; unknown names are 0."""
    known = [x for i, n in enumerate(NOTES) for x in (F.lit(n), F.lit(i))]
    known += [x for flat, sharp in FLATS.items() for x in (F.lit(flat), F.lit(NOTES.index(sharp)))]
    return F.coalesce(F.try_element_at(F.create_map(*known), col(name)), F.lit(0))


def audio_format(path: str | Column) -> Column:
    """The format that a path's extension names, ``Unknown`` if none; contents are not read."""
    ext = F.lower(F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1))
    out = F.lit("Unknown")
    for name, extensions in FORMATS.items():
        out = F.when(ext.isin(*extensions), F.lit(name)).otherwise(out)
    return out


def saturating_long(x: Column, bits: int) -> Column:
    """Truncated towards zero and held within an unsigned range; null and NaN become 0."""
    top = float(2**bits - 1) if bits < 53 else float(2**62)
    safe = F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(clamp(x, 0.0, top))
    return F.floor(safe).cast("long")


def hash_step(h: Column, value: Column) -> Column:
    """One step of the 32-bit multiplicative hash: (h xor value) * 0x9E3779B9 modulo 2**32.

    The factor is split into halves so that no product leaves 63 bits.
    """
    x = h.bitwiseXOR(value)
    return (x * F.lit(0x79B9) + F.shiftleft((x * F.lit(0x9E37)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def hamming_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hex16(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def bin_hz(bin_: Column, rate: Column | float, size: int) -> Column:
    """Centre frequency of an FFT bin."""
    return bin_ * col(rate) / F.lit(float(size))


def _channel(x: Column) -> Column:
    return F.floor(clamp(x, 0.0, 255.0)).cast("int")


def colormap(name: str, value: str | Column) -> Column:
    """struct<r, g, b> of a value in 0..1 by the map ``viridis``, ``plasma``, ``inferno`` or ``grayscale``.

    Viridis is piecewise linear: its knots (position, red, green, blue) are fixed values below.
    """
    v = clamp(col(value))
    if name == "viridis":
        channels = [_channel(_piecewise(v, VIRIDIS_RED)), _channel(_piecewise(v, VIRIDIS_GREEN)), _channel(_piecewise(v, VIRIDIS_BLUE))]
    elif name == "plasma":
        channels = [_channel(240 * F.pow(v, F.lit(0.7))), _channel(20 + 100 * v), _channel(140 * F.pow(1 - v, F.lit(1.5)))]
    elif name == "inferno":
        channels = [_channel(v * v * 255), _channel(v * 150), _channel((1 - v * v) * 200)]
    elif name == "grayscale":
        channels = [_channel(v * 255)] * 3
    else:
        raise ValueError(f"unknown colour map {name}")
    return F.struct(*[c.alias(n) for c, n in zip(channels, "rgb", strict=True)])


# The knots of the viridis approximation, as (position, value at it, value reached at the next knot).
VIRIDIS_RED = ((0.0, 68.0, 147.0), (0.5, 147.0, 253.0))
VIRIDIS_GREEN = ((0.0, 1.0, 86.0), (0.5, 86.0, 220.0))
VIRIDIS_BLUE = ((0.0, 84.0, 114.0), (0.25, 114.0, 84.0), (0.5, 84.0, 43.0), (0.75, 43.0, 33.0))


def _piecewise(v: Column, knots: tuple[tuple[float, float, float], ...]) -> Column:
    out = None
    for i, (at, low, high) in reversed(list(enumerate(knots))):
        width = (knots[i + 1][0] if i + 1 < len(knots) else 1.0) - at
        piece = F.lit(low) + (v - at) * F.lit((high - low) / width)
        out = piece if out is None else F.when(v < knots[i + 1][0], piece).otherwise(out)
    return out


def window_values(kind: str, n: int) -> list[float]:
    """A symmetric window of ``n`` points: hann, hamming, blackman, nuttall or rectangular.

    Each is a sum of cosines whose coefficients are fixed values.
    """
    terms = {
        "hann": (0.5, 0.5),
        "hamming": (0.54, 0.46),
        "blackman": (0.42, 0.5, 0.08),
        "nuttall": (0.355768, 0.487396, 0.144232, 0.012604),
        "rectangular": (1.0,),
    }["blackman" if kind == "kaiser" else kind]
    step = 2 * math.pi / (n - 1) if n > 1 else 0.0
    return [sum((-1) ** k * a * math.cos(k * step * i) for k, a in enumerate(terms)) for i in range(n)]
