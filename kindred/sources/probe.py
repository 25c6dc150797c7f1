"""Probe output (streams and format as JSON) to media facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = """streams array<struct<index:int, codec_name:string, codec_long_name:string, codec_type:string, width:int, height:int, channels:int, channel_layout:string, pix_fmt:string, sample_rate:string,
 bit_rate:string, r_frame_rate:string, color_transfer:string, side_data_list:array<struct<side_data_type:string>>>>, format struct<duration:string, bit_rate:string>"""


def _frame_rate(s: Column) -> Column:
    """num/den as a number; -1 if either is not above 0; null if there is no fraction of whole numbers."""
    parts = F.split(s, "/")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.when((a > 0) & (b > 0), a / b).otherwise(-1.0)).cast("float")


def hdr_format(transfer: Column, side_data: Column) -> Column:
    """Name of the high dynamic range format by the transfer function, refined by side data for PQ; null for none."""
    has = lambda word: F.coalesce(F.upper(side_data).contains(word), F.lit(False))
    return F.when(F.lower(transfer) == "arib-std-b67", "HLG").when(F.lower(transfer) == "smpte2084", F.when(has("DOVI"), "Dolby Vision").when(has("SMPTE2094"), "HDR10+").otherwise("HDR10"))


def media_info(json: str | Column) -> Column:
    """struct(duration, streams) of a probe's JSON: whole seconds (null if below 0 or no number), and of each stream its facts.

    Types of side data are joined by "|". If no stream has a bit rate, the first gets the
    format's. Text that is no such JSON gives a null duration and no streams.
    """
    p = F.from_json(json, SCHEMA)
    seconds = p["format"]["duration"].try_cast("double")
    streams = F.coalesce(p["streams"], F.array().cast("array<struct<" + SCHEMA[SCHEMA.index("<struct<") + 8 : SCHEMA.rindex(">>, format")] + ">>"))
    found = F.exists(streams, lambda s: s["bit_rate"].try_cast("long").isNotNull())
    spare = p["format"]["bit_rate"].try_cast("long")

    def facts(s: Column, i: Column) -> Column:
        side = F.nullif(F.array_join(s["side_data_list"]["side_data_type"], "|"), F.lit(""))
        rate = F.coalesce(s["bit_rate"].try_cast("long"), F.when(~found & (i == 0), spare))
        same = [s[c].alias(c) for c in ("index", "codec_name", "codec_long_name", "codec_type", "width", "height", "channels", "channel_layout", "pix_fmt")]
        return F.struct(*same, s["sample_rate"].try_cast("int").alias("sample_rate"), rate.alias("bit_rate"), _frame_rate(s["r_frame_rate"]).alias("frame_rate"), hdr_format(s["color_transfer"], side).alias("hdr_format"), side.alias("side_data"))

    return F.struct(F.when(seconds >= 0, F.floor(seconds)).alias("duration"), F.transform(streams, facts).alias("streams"))
