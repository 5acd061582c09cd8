"""Column-level functions: cell references, text classification, similarity kernels, formulas."""
