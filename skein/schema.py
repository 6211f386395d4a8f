"""Column names, feature groups and parameters of the flow data model."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Column names, classes, ports and parameters of the data model.
IDENTITY_COLUMNS = {
    "FlowID": T.LongType(),
    "SrcAddr": T.StringType(),
    "SrcPort": T.IntegerType(),
    "DstAddr": T.StringType(),
    "DstPort": T.IntegerType(),
    "Protocol": T.StringType(),
    "FlowDuration/s": T.DoubleType(),
}
NETWORK_COLUMNS = [
    "TxPackets",
    "RxPackets",
    "LostPackets",
    "TxBytes",
    "RxBytes",
    "TxPacketRate/s",
    "RxPacketRate/s",
    "TxByteRate/s",
    "RxByteRate/s",
    "MeanPacketSize",
    "MeanDelay/s",
    "MeanJitter/s",
    "Throughput/Kbps",
    "PacketDropRate",
    "AverageHopCount",
]
CLASSES = [
    "Blackhole Attack",
    "Flooding Attack",
    "Normal Traffic",
    "Sybil Attack",
    "Wormhole Attack",
]
NORMAL = "Normal Traffic"
PORT_FLAGS = {9: 0, 654: 1}
MANIFOLDS = ["C2", "Network", "Physical"]
HOMOLOGY_DIMS = [0, 1, 2]
BAR_STATISTICS = [
    "count",
    "mean_persistence",
    "std_persistence",
    "max_persistence",
    "total_persistence",
    "mean_birth",
    "mean_death",
    "entropy",
]
KEY_FEATURES = [
    "packet_drop_rate",
    "tx_packet_rate_s",
    "rx_packet_rate_s",
    "throughput_kbps",
    "lost_packets",
    "mean_delay_s",
]
SEED = 42
TEST_FRACTION = 0.2
N_FOLDS = 5
K_NEIGHBORS = 100
FRAME_BEFORE = 25
FRAME_AFTER = 24
MAX_EDGE = 5.0
SIGMA = 3.0
BASELINE_SAMPLE = 1000
ENTROPY_EPSILON = 1e-10
HISTOGRAM_BINS = 50


def snake(name: str) -> str:
    """``TxPacketRate/s`` -> ``tx_packet_rate_s``."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).lower()


NETWORK_FEATURES = [snake(c) for c in NETWORK_COLUMNS]
C2_FEATURES = [
    "src_addr_octet",
    "src_port_binary",
    "dst_addr_octet",
    "dst_port_binary",
    "flow_duration_s",
]
# The physical group repeats two network columns; its copies get a prefix.
PHYSICAL_SOURCES = {
    "phys_mean_delay_s": "mean_delay_s",
    "phys_average_hop_count": "average_hop_count",
}
MANIFOLD_FEATURES = {
    "C2": C2_FEATURES,
    "Network": NETWORK_FEATURES,
    "Physical": list(PHYSICAL_SOURCES),
}
RAW_FEATURES = [c for m in MANIFOLDS for c in MANIFOLD_FEATURES[m]]
BAR_FEATURES = [
    f"{m}_H{d}_{s}" for m in MANIFOLDS for d in HOMOLOGY_DIMS for s in BAR_STATISTICS
]

FLOW_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in IDENTITY_COLUMNS.items()]
    + [T.StructField(n, T.DoubleType()) for n in NETWORK_COLUMNS]
    + [T.StructField("label", T.StringType())]
)
BAR_TYPE = T.StructType(
    [
        T.StructField("dim", T.IntegerType()),
        T.StructField("birth", T.DoubleType()),
        T.StructField("death", T.DoubleType()),
    ]
)
BARS_TYPE = T.ArrayType(BAR_TYPE)
