"""Folders of the driver tables used by the tests."""

SF_SMALL = "/root/testdata/sf0.001"
