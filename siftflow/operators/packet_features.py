"""Window features of packets: 39 columns per address and five-minute window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flow import has_flag, share
from ..schemas import ARP_PROTO, PACKET_FEATURES, WINDOW_SECONDS

# Ports of each application class.
APPLICATIONS = {"HTTP": [80], "HTTPS": [443], "Telnet": [23], "DNS": [53], "SMTP": [25], "SSH": [22], "IRC": [194, 6667], "DHCP": [67, 68]}
FLAGS = {"fin": "F", "syn": "S", "rst": "R", "psh": "P", "ack": "A", "ece": "E", "cwr": "C"}
PROTOCOLS = {"TCP": 6, "UDP": 17, "ICMP": 1, "IGMP": 2, "ARP": ARP_PROTO}


def packet_roles(packets: DataFrame) -> DataFrame:
    """Every packet under its source and its destination; ``port`` is the other side's service port."""
    both = F.array(
        F.struct(F.coalesce("src_ip", F.lit("")).alias("ip"), F.coalesce("dst_port", F.lit(0)).alias("port")),
        F.struct(F.coalesce("dst_ip", F.lit("")).alias("ip"), F.coalesce("src_port", F.lit(0)).alias("port")),
    )
    kept = packets.where("timestamp is not null").select(
        (F.floor(F.col("timestamp") / WINDOW_SECONDS) * WINDOW_SECONDS).cast("long").alias("win"),
        "timestamp",
        F.coalesce("length", F.lit(0)).cast("double").alias("length"),
        F.coalesce("proto", F.lit(0)).alias("proto"),
        F.coalesce("ttl", F.lit(0)).alias("ttl"),
        F.coalesce("tcp_flags", F.lit("")).alias("tcp_flags"),
        F.inline(both),
    )
    return kept.where("ip <> ''")


def dominant_protocol(tcp: Column, udp: Column, icmp: Column, igmp: Column) -> Column:
    """The number of the most frequent of four protocols; of equals the earlier, 6 if there is none."""
    most = F.greatest(tcp, udp, icmp, igmp)
    return F.when(tcp == most, 6).when(udp == most, 17).when(icmp == most, 1).otherwise(2)


def packet_features(packets: DataFrame) -> DataFrame:
    """``(ip, win)`` and the 39 features of ``PACKET_FEATURES``; one aggregation, no sort.

    The gaps between sorted times add up to the span, so their mean needs the extremes only.
    """
    c = F.col
    sums = packet_roles(packets).groupBy("ip", "win").agg(
        F.count("*").alias("n"),
        *(F.count_if(has_flag(c("tcp_flags"), letter)).alias(f"k_{name}") for name, letter in FLAGS.items()),
        *(F.count_if(c("proto") == number).alias(f"p_{name}") for name, number in PROTOCOLS.items()),
        *(F.count_if(c("port").isin(ports)).alias(f"a_{name}") for name, ports in APPLICATIONS.items()),
        F.sum("ttl").alias("ttl"),
        F.sum("length").alias("sum"),
        F.min("length").alias("min"),
        F.max("length").alias("max"),
        F.coalesce(F.var_samp("length"), F.lit(0.0)).alias("var"),
        (F.max("timestamp") - F.min("timestamp")).alias("span"),
    )
    n = c("n")
    out = {
        "Header_Length": (20 * c("p_TCP") + 8 * (c("p_UDP") + c("p_ICMP"))) / n,
        "Time_To_Live": c("ttl") / n,
        "Rate": F.when(n >= 2, share(n, c("span"))).otherwise(0.0),
        **{f"{k}_flag_number": c(f"k_{k}") / n for k in FLAGS},
        **{f"{k}_count": c(f"k_{k}") for k in ("syn", "ack", "fin", "rst")},
        **{k: c(f"a_{k}") / n for k in APPLICATIONS},
        **{k: c(f"p_{k}") / n for k in PROTOCOLS},
        "IPv": F.lit(1.0),
        "LLC": F.lit(0.0),
        "Tot sum": c("sum"),
        "Min": c("min"),
        "Max": c("max"),
        "AVG": c("sum") / n,
        "Std": F.sqrt("var"),
        "Tot size": c("sum") / n,
        "IAT": F.when(n >= 2, c("span") / (n - 1)).otherwise(0.0),
        "Number": n,
        "Variance": c("var"),
        "Protocol Type": dominant_protocol(c("p_TCP"), c("p_UDP"), c("p_ICMP"), c("p_IGMP")),
    }
    return sums.select("ip", "win", *(out[f].cast("double").alias(f) for f in PACKET_FEATURES))
