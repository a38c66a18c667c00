"""Column expressions on one hit: time, channel, flags, charge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the extras flag field (shifted down to bit 0).
FLAG_LOST_COUNTED = 1 << 2
FLAG_1024_COUNTED = 1 << 3
FLAG_OVER_RANGE = 1 << 4
FLAG_TRIGGER_LOST = 1 << 5
Q_SATURATED = 65535
QS_SATURATED = 32767


def compose_ts_ps(ttt: Column, ext: Column, fine: Column, tick_ps: int) -> Column:
    """Picoseconds from the 31-bit tag, its 16-bit extension and the 10-bit fine time."""
    t = F.shiftleft(ext.cast("long"), 31).bitwiseOR(ttt.cast("long")) * F.lit(tick_ps).cast("long")
    return t + F.shiftright(fine.cast("long") * F.lit(tick_ps).cast("long"), 10)


def slot_of(board: Column, ch: Column, board_channels: int = 16) -> Column:
    return (board * board_channels + ch).cast("int")


def couple_channel(couple: Column, word: Column) -> Column:
    """Channel of a two-channel block: couple number and the top bit of the time word."""
    return (couple * 2 + F.shiftrightunsigned(word.cast("long"), 31).bitwiseAND(F.lit(1))).cast("int")


def qdc_channel(group: Column, charge_word: Column) -> Column:
    return (group * 8 + F.shiftrightunsigned(charge_word.cast("long"), 28).bitwiseAND(F.lit(0xF))).cast("int")


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "lost_counted": has_flag(F.col("flags"), FLAG_LOST_COUNTED),
            "counted_1024": has_flag(F.col("flags"), FLAG_1024_COUNTED),
            "over_range": has_flag(F.col("flags"), FLAG_OVER_RANGE),
            "trigger_lost": has_flag(F.col("flags"), FLAG_TRIGGER_LOST),
        }
    )


def good_hit(dpp: str = "PSD") -> Column:
    """Neither piled up nor out of range: the QDC layout reports over-range apart, the others do not."""
    ok = ~F.col("pur")
    return ok & ~has_flag(F.col("flags"), FLAG_OVER_RANGE) if dpp == "QDC" else ok


def psd(qlong: Column, qshort: Column) -> Column:
    return F.try_divide((qlong - qshort).cast("double"), qlong.cast("double"))


def psd_bin(qlong: Column, qshort: Column, bins: int = 100) -> Column:
    """Integer PSD bin, 1 in the last; NULL where the PSD is not defined (counted apart)."""
    ok = (qlong > 0) & (qlong < Q_SATURATED) & (qshort < QS_SATURATED) & (qshort <= qlong)
    whole = (qlong.cast("long") - qshort.cast("long")) * bins
    q = qlong.cast("long")
    return F.when(ok, F.least((whole - F.pmod(whole, q)) / F.when(ok, q), F.lit(bins - 1)).cast("int"))


def psd_out(qlong: Column, qshort: Column) -> Column:
    """Inside the charge range but without a PSD: short gate saturated or above the long one."""
    return (qlong > 0) & (qlong < Q_SATURATED) & ((qshort >= QS_SATURATED) | (qshort > qlong))


def linear_value(raw: Column, scale: Column, offset: Column, open_at: Column | None = None) -> Column:
    """raw * scale + offset; NULL for NaN, infinity and an open input (at or above ``open_at``)."""
    bad = F.isnan(raw) | (F.abs(raw) == float("inf"))
    if open_at is not None:
        bad = bad | F.coalesce(raw >= open_at, F.lit(False))
    return F.when(~bad, raw * F.coalesce(scale, F.lit(1.0)) + F.coalesce(offset, F.lit(0.0)))


def waveform_mv(wf: Column, volts_full_scale: float, bits: int = 14) -> Column:
    """Samples in mV for an input range."""
    k = volts_full_scale * 1000.0 / (1 << bits)
    return F.transform(wf, lambda x: x * F.lit(k))
