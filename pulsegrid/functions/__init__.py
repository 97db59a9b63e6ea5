"""Small numpy kernels that run inside Arrow groups."""
