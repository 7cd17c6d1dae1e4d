"""Production weights of the mix: shares of its characters."""

WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.05}
#: all other sources together
REST = 0.60
