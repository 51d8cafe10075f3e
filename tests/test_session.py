"""Runtime settings."""

from sessionrank.session import SCAN_BYTES, SCAN_SETTING, tune


def test_large_pieces_of_files_are_lowered_and_small_ones_stay(spark):
    before = spark.conf.get(SCAN_SETTING)
    try:
        for given, wanted in (("128m", SCAN_BYTES), ("134217728b", SCAN_BYTES), ("1GB", SCAN_BYTES), ("200000000", SCAN_BYTES)):
            spark.conf.set(SCAN_SETTING, given)
            assert tune(spark).conf.get(SCAN_SETTING) == str(wanted)
        spark.conf.set(SCAN_SETTING, "16m")
        assert tune(spark).conf.get(SCAN_SETTING) == "16m"
    finally:
        spark.conf.set(SCAN_SETTING, before)
