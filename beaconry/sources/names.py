"""A loader for each dataset under the name that its publishers use."""

from __future__ import annotations

from functools import partial

from .catalog import load_dataset, resolve

#: The public names of the datasets.
NAMES = (
    "UJIndoorLoc", "SODIndoorLoc", "LongTermWiFi", "Tampere", "WLANRSSI", "TUJI1", "RSSBased", "BLEIndoor", "iBeaconRSSI", "BLERSSIU_UCI", "UWBIndoor", "UWBRanging", "MagneticIndoor",
    "VLCIndoor", "UltrasoundIndoor", "RFIDIndoor", "WiFiIMUHybrid", "WiFiMagneticHybrid", "MultiModalIndoor", "SensorFusion", "CSIIndoor", "CSIFingerprint", "HWILD", "CSU", "WILDv2",
    "OpenCSI", "HALOC", "CSIBench", "MaMIMOCSI", "DICHASUS", "ESPARGOS", "CSI2Pos", "CSI2TAoA", "DeepMIMO", "MaMIMOUAV", "WiFiCSID2D",
)
#: Names that aren't a dataset's own when written small.
OTHERS = {
    "RSSBased": "rss_based", "BLEIndoor": "ble_indoor", "iBeaconRSSI": "ibeacon_rssi", "BLERSSIU_UCI": "ble_rssi_uci", "UWBIndoor": "uwb_indoor", "UWBRanging": "uwb_ranging", "MagneticIndoor": "magnetic_indoor",
    "VLCIndoor": "vlc_indoor", "UltrasoundIndoor": "ultrasound", "RFIDIndoor": "rfid_indoor", "WiFiIMUHybrid": "wifi_imu", "WiFiMagneticHybrid": "wifi_magnetic", "MultiModalIndoor": "multimodal",
    "SensorFusion": "sensor_fusion", "CSIIndoor": "csi_indoor", "CSIFingerprint": "csi_fingerprint", "WILDv2": "wild_v2", "CSIBench": "csi_bench", "MaMIMOCSI": "mamimo_csi", "MaMIMOUAV": "mamimo_uav", "WiFiCSID2D": "wifi_csi_d2d",
}


def loader(name: str):
    """``loader("Tampere")(spark, root, split, ...)`` reads that dataset like ``load_dataset``."""
    if name not in NAMES:
        raise AttributeError(name)
    return partial(_loaded, resolve(OTHERS.get(name, name)))


def _loaded(name: str, spark, root: str, split: str | None = None, **options):
    return load_dataset(spark, name, root, split, **options)
