"""Schemas of flow and packet records, and the names of the feature columns."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A flow as the window features read it; times are ISO strings in UTC.
FLOW = _struct(first=_S, last=_S, in_packets=_L, in_bytes=_L, proto=_I, tcp_flags=_S, src_port=_I, dst_port=_I, src4_addr=_S, dst4_addr=_S)
#: What rule inputs carry besides, and what labelled conversions add.
RULE_FLOW = T.StructType([*FLOW.fields, *_struct(type=_S, received=_S, ip_next_hop=_S, in_src_mac=_S, out_dst_mac=_S, export_sysid=_I).fields])
LABELLED_FLOW = T.StructType([*RULE_FLOW.fields, T.StructField("label", _S)])
#: A decoded packet; ARP has protocol 2054.
PACKET = _struct(timestamp=_D, src_ip=_S, dst_ip=_S, src_port=_I, dst_port=_I, length=_I, proto=_I, ttl=T.ShortType(), tcp_flags=_S)

# Feature names in the order of the model's inputs.
FLOW_FEATURES = [
    "flow_count", "unique_dst_ips", "unique_dst_ports", "total_bytes", "total_packets", "avg_bytes_per_flow",
    "avg_packets_per_flow", "pct_tcp", "pct_udp", "pct_icmp", "pct_well_known_ports", "pct_high_ports",
    "avg_duration", "iat_mean", "iat_variance", "port_symmetry", "ip_port_ratio", "avg_payload_per_packet",
    "pct_syn_only", "pct_rst", "iat_cv",
]
PACKET_FEATURES = [
    "Header_Length", "Time_To_Live", "Rate", "fin_flag_number", "syn_flag_number", "rst_flag_number",
    "psh_flag_number", "ack_flag_number", "ece_flag_number", "cwr_flag_number", "syn_count", "ack_count",
    "fin_count", "rst_count", "IGMP", "HTTPS", "HTTP", "Telnet", "DNS", "SMTP", "SSH", "IRC", "TCP", "UDP",
    "DHCP", "ARP", "ICMP", "IPv", "LLC", "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number",
    "Variance", "Protocol Type",
]

WINDOW_SECONDS = 300
ARP_PROTO = 2054
