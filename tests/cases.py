"""Constants that the tests share."""

SMALL = "/root/testdata/sf0.001"
AS_OF = "2026-01-01 00:00:00"
