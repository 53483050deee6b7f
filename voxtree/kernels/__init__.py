"""NumPy kernels that run on whole images or Arrow batches inside tasks."""
