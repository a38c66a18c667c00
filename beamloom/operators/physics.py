"""Maps and sums of built events: strips, particle identification, spectrometer, rays."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions.binning import linear_bin
from beamloom.functions.polygon import in_polygon
from beamloom.operators.hist import hist2d
from beamloom.operators.joins import channel_pivot
from beamloom.sources.eventfiles import hits_of

# Fixed values of the focal-plane detector.
SPECTROMETER_CHANNELS = {"SR": 0, "SL": 1, "FR": 9, "FL": 8, "BR": 11, "BL": 10, "Cath": 7, "AF": 13, "AB": 15}
PLANE_SEPARATION = 36.0
DISPERSION = 1.96
MAGNIFICATION = 0.39
LIGHT_SPEED = 299.792458
FRONT_SCALE = 2.1
BACK_SCALE = 1.98
FOCAL_HALF = 4.28625
RAY_SEPARATION = 42.8625


def neutron_gamma(hits: DataFrame, long: str, short: str, xr: tuple, yr: tuple, keys: tuple[str, ...] = ()) -> DataFrame:
    """Map of (long - short) / long against long."""
    p = F.try_divide(F.col(long) - F.col(short), F.col(long))
    return hist2d(hits, F.col(long), xr, p, yr, keys)


def board_spectra(hits: DataFrame, bins: int) -> DataFrame:
    """(board, ch, long bin, short bin, n): the channel-energy map and both spectra add up from it."""
    def b(c: str) -> Column:
        return F.least(F.expr(f"cast(cast({c} as long) * {bins} div 65536 as int)"), F.lit(bins - 1))

    return hits.groupBy("board", "ch", b("qlong").alias("e_bin"), b("qshort").alias("e2_bin")).agg(F.count(F.lit(1)).alias("n"))


def strip_sums(hits: DataFrame, event: str) -> DataFrame:
    """Left, right and total energy per strip and event."""
    left, right = F.col("side") == "left", F.col("side") == "right"
    return hits.groupBy(event, "strip").agg(
        F.sum(F.when(left, F.col("energy"))).alias("left_sum"),
        F.sum(F.when(right, F.col("energy"))).alias("right_sum"),
        F.sum("energy").alias("both_sum"),
    )


def pid_columns(hits: DataFrame, event: str, de: int, e: int, de_factor: float = 1.0, energy: str = "e", time: str = "t") -> DataFrame:
    """Per event: energy loss, total energy and time of flight of a two-detector telescope."""
    p = channel_pivot(hits, event, {"de": de, "e": e}, {"e": energy, "t": time})
    loss = F.col("e_de") * de_factor
    return p.select(
        event, loss.alias("de"), F.col("e_e").alias("e"), (loss + F.col("e_e")).alias("total"), (F.col("t_e") - F.col("t_de")).alias("tof")
    )


def cut_rates(in_cut: DataFrame, time: str, units_per_s: float) -> DataFrame:
    """Counts of each cut over the time between its first and last point; NULL for a single one."""
    return in_cut.groupBy("cut").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.count(F.lit(1)).cast("double"), (F.max(time) - F.min(time)) / F.lit(units_per_s)).alias("rate"),
    )


@dataclass(frozen=True)
class Reaction:
    """Two-body kinematics, computed once; masses and kinetic energy in MeV, angle in degrees, field in tesla."""

    target: float
    beam: float
    recoil: float
    heavy: float
    recoil_z: int
    beam_ke: float
    angle: float
    field: float

    @property
    def total(self) -> float:
        return self.target + self.beam_ke + self.beam

    @property
    def k1(self) -> float:
        return math.sqrt(2 * self.beam * self.beam_ke + self.beam_ke**2)

    @property
    def cos(self) -> float:
        return math.cos(math.radians(self.angle))

    def recoil_momentum(self, ex: float = 0.0) -> float:
        """Momentum of the recoil for an excitation of the heavy partner."""
        mb = self.heavy + ex
        s = self.total**2 - self.k1**2
        d = self.recoil**2 - mb**2
        root = s**2 + d**2 - 2 * self.total**2 * (self.recoil**2 + mb**2)
        root += 2 * self.k1**2 * (self.recoil**2 * math.cos(2 * math.radians(self.angle)) + mb**2)
        return (self.k1 * (s + d) * self.cos + self.total * math.sqrt(root)) / (2 * (self.total**2 - (self.k1 * self.cos) ** 2))

    @property
    def momentum_per_rho(self) -> float:
        return self.recoil_z * self.field * LIGHT_SPEED

    @property
    def rho0(self) -> float:
        return self.recoil_momentum() / self.momentum_per_rho

    @property
    def z_offset(self) -> float:
        p = self.recoil_momentum()
        ke = math.sqrt(self.recoil**2 + p * p) - self.recoil
        h = math.sqrt(self.recoil * self.beam * self.beam_ke / ke)
        k = h * math.sin(math.radians(self.angle)) / (self.recoil + self.heavy - h * self.cos)
        return -100.0 * self.rho0 * k * DISPERSION * MAGNIFICATION

    def excitation(self, rho_m: Column) -> Column:
        """Excitation energy of the heavy partner from the bending radius in metres."""
        ka = rho_m * self.momentum_per_rho
        inside = self.total**2 - self.k1**2 + self.recoil**2 + 2 * self.cos * self.k1 * ka - 2 * self.total * F.sqrt(F.lit(self.recoil**2) + ka * ka)
        return F.when(inside >= 0, F.sqrt(inside)) - self.heavy


def spectrometer(hits: DataFrame, event: str, z_offset: float, scale: float = 2.0, channels: dict[str, int] | None = None) -> DataFrame:
    """Per event: scintillator mean, both wire positions, angle and focal-plane position. Times are whole ns."""
    p = channel_pivot(hits, event, channels or SPECTROMETER_CHANNELS, {"e": "e", "t": "t_ns"})
    def fired(c: str) -> Column:
        return F.coalesce(F.col(c) > 0, F.lit(False))

    avg = (
        F.when(fired("e_SR") & fired("e_SL"), (F.col("e_SR") + F.col("e_SL")) / 2)
        .when(fired("e_SR"), F.col("e_SR").cast("double"))
        .when(fired("e_SL"), F.col("e_SL").cast("double"))
        .otherwise(F.lit(-1.0))
    )

    def wire(left: str, right: str, k: float) -> Column:
        d = (F.col(left) - F.col(right)).cast("double")
        return F.when(fired(left) & fired(right) & (d != 0), d / scale / k)

    x1, x2 = wire("t_FL", "t_FR", FRONT_SCALE), wire("t_BL", "t_BR", BACK_SCALE)
    q = p.withColumns({"s_avg": avg, "x1": x1, "x2": x2})
    slope = F.atan((F.col("x2") - F.col("x1")) / PLANE_SEPARATION)
    theta = F.when(F.col("x2") > F.col("x1"), slope).when(F.col("x2") < F.col("x1"), slope + math.pi).when(F.col("x2") == F.col("x1"), math.pi / 2)
    w1 = 0.5 - z_offset / FOCAL_HALF
    return q.withColumns({"theta": theta, "x_avg": w1 * F.col("x1") + (1 - w1) * F.col("x2")})


def angle_gate(lo: float = 0.5, hi: float = 1.2) -> Column:
    """The angle gate; an event with one wire only has no angle and is not cut by it."""
    return F.coalesce(F.col("theta").between(lo, hi), F.lit(True))


def excitation_spectrum(
    tracks: DataFrame, reaction: Reaction, lo: float, hi: float, bins: int, rho_offset: float = 0.0, rho_scaling: float = 1.0
) -> DataFrame:
    """Excitation spectrum: focal-plane position to radius to energy, one expression over all events."""
    rho = (F.col("x_avg") - rho_offset) / 1000.0 / rho_scaling + reaction.rho0
    x = tracks.filter(angle_gate()).withColumn("ex", reaction.excitation(rho))
    return x.withColumn("bin", linear_bin(F.col("ex"), lo, hi, bins)).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def ray_plot(tracks: DataFrame, xr: tuple, depths: int = 400, z_lo: float = -50.0, z_hi: float = 50.0) -> DataFrame:
    """Each track sampled at fixed depths between and beyond the wires: (depth, bx, n).

    Tracks with the same pair of wire positions are counted first and sampled once.
    """
    t = tracks.filter(F.col("x1").isNotNull() & F.col("x2").isNotNull()).groupBy("x1", "x2").agg(F.count(F.lit(1)).alias("m"))
    d = t.select("x1", "x2", "m", F.explode(F.sequence(F.lit(0), F.lit(depths - 1))).alias("depth"))
    z = z_lo + (z_hi - z_lo) / depths * F.col("depth")
    x = (z / RAY_SEPARATION + 0.5) * (F.col("x2") - F.col("x1")) + F.col("x1")
    return d.withColumn("bx", linear_bin(x, *xr)).filter("bx is not null").groupBy("depth", "bx").agg(F.sum("m").alias("n"))


def offline_spectrometer(
    events: DataFrame,
    reaction: Reaction,
    channels: dict[str, int],
    x_range: tuple[float, float, int],
    charge_range: tuple[float, float, int],
    ex_range: tuple[float, float, int],
    pid_cut: list[tuple[float, float]] | None = None,
    z_offset: float = 0.0,
    rho_offset: float = 0.0,
    rho_scaling: float = 1.0,
    scale: float = 2.0,
) -> DataFrame:
    """The whole analysis of saved events in one pass: (hist, bx, by, n).

    ``pid`` (charge of SL against AB) is filled ahead of the cut; ``focal`` (front against back wire), ``front``, ``back``, ``avg``,
    ``avg_theta`` (a hundred bins of angle over the gate) and ``ex`` by events inside the cut and the angle gate that have a wire
    position. A channel that did not fire has charge 0 for the cut. Only the arrays of channel, charge and time are read.
    """
    hits = hits_of(events, "ch", "e", "e_t").select(F.struct("run", "ev_id").alias("event"), "ch", "e", F.col("e_t").alias("t_ns"), F.col("i").alias("pos"))
    t = spectrometer(hits, "event", z_offset, scale, channels)
    total, part = F.coalesce("e_SL", F.lit(0)), F.coalesce("e_AB", F.lit(0))
    inside = in_polygon(total.cast("double"), part.cast("double"), pid_cut) if pid_cut else F.lit(True)
    kept = inside & angle_gate() & (F.col("x1").isNotNull() | F.col("x2").isNotNull())
    ex = reaction.excitation((F.col("x_avg") - rho_offset) / 1000.0 / rho_scaling + reaction.rho0)
    one = F.lit(0)

    def entry(name: str, ok: Column, bx: Column, by: Column = one) -> Column:
        return F.when(ok & bx.isNotNull() & by.isNotNull(), F.struct(F.lit(name).alias("hist"), bx.cast("int").alias("bx"), by.cast("int").alias("by")))

    x = {c: linear_bin(F.col(c), *x_range) for c in ("x1", "x2", "x_avg")}
    entries = [
        entry("pid", (total > 0) & (part > 0), linear_bin(total.cast("double"), *charge_range), linear_bin(part.cast("double"), *charge_range)),
        entry("focal", kept, x["x1"], x["x2"]), entry("front", kept, x["x1"]), entry("back", kept, x["x2"]), entry("avg", kept, x["x_avg"]),
        entry("avg_theta", kept, x["x_avg"], linear_bin(F.col("theta"), 0.5, 1.2, 100)), entry("ex", kept, linear_bin(ex, *ex_range)),
    ]
    filled = t.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
    return filled.groupBy("hist", "bx", "by").agg(F.count(F.lit(1)).alias("n"))
