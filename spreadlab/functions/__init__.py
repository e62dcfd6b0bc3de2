"""Column expressions and the numeric kernels of grouped functions."""
