"""Column expressions and kernels: geometry, skeletons, signals."""
