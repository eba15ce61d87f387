"""Text forms of feature values and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which features take which form.
PERCENT = {"pct_tcp", "pct_udp", "pct_icmp", "pct_well_known_ports", "pct_high_ports", "pct_syn_only", "pct_rst"}
FRACTION = {
    "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number", "ack_flag_number", "ece_flag_number",
    "cwr_flag_number", "IGMP", "HTTPS", "HTTP", "Telnet", "DNS", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP", "ARP",
    "ICMP", "IPv", "LLC",
}
WHOLE = {"flow_count", "unique_dst_ips", "unique_dst_ports", "total_packets", "syn_count", "ack_count", "fin_count", "rst_count", "Number", "Time_To_Live"}
VOLUME = {"total_bytes", "Tot sum"}
SECONDS = {"avg_duration", "iat_mean", "IAT"}
BYTES = {"Header_Length", "Min", "Max", "AVG", "Tot size"}
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP", 2: "IGMP"}


def feature_text(name: str, value: float) -> str:
    """A feature's value as reports show it."""
    if name in PERCENT:
        return f"{value:.1f}%"
    if name in FRACTION:
        return f"{value * 100:.1f}%"
    if name in WHOLE:
        return f"{value:.0f}"
    if name in VOLUME:
        for unit, size in (("MB", 1 << 20), ("KB", 1 << 10)):
            if value >= size:
                return f"{value / size:.1f}{unit}"
        return f"{value:.0f}B"
    if name in SECONDS:
        return f"{value:.3f}s"
    if name in BYTES:
        return f"{value:.1f}B"
    if name == "Rate":
        return f"{value:.1f} pps"
    if name == "Protocol Type":
        return PROTOCOL_NAMES.get(int(value), f"{value:.0f}")
    return f"{value:.2f}"


def file_size(size: Column) -> Column:
    """A byte count in B, KB, MB or GB."""
    out = F.when(size < 1 << 10, F.format_string("%d B", size))
    for unit, at in (("KB", 10), ("MB", 20)):
        out = out.when(size < 1 << (at + 10), F.format_string(f"%.1f {unit}", size / (1 << at)))
    return out.otherwise(F.format_string("%.1f GB", size / (1 << 30)))
