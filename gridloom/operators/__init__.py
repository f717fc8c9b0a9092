"""Array operators: views, access modes, kernels, reductions."""
