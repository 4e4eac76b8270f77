"""Where the smallest test tables lie."""

SMALL = "/root/testdata/sf0.001"
