"""Raw device readings to physical units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(x: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(x), x)


def adc_to_mv(adc: Column, leads_off: Column) -> Column:
    """12-bit reading at 3.3 V, centred on 1.65 V, amplifier gain 1100."""
    volts = adc / 4095.0 * 3.3
    return F.when(leads_off, 0.0).otherwise((volts - 1.65) * 1000.0 / 1100.0)


def leads_off(lo_plus: Column, lo_minus: Column) -> Column:
    return (lo_plus == 1) | (lo_minus == 1)


def spo2_estimate(ir: Column, red: Column) -> Column:
    """Oxygen saturation, NULL when no finger is on the sensor."""
    raw = 110.0 - 25.0 * (red / ir)
    return F.when(ir > 50000, F.least(F.greatest(raw, F.lit(85.0)), F.lit(100.0)))


def plausible_temperature(celsius: Column) -> Column:
    return F.when((celsius > 20.0) & (celsius < 45.0), celsius)
