"""DataFrame operators over sampled channels, events, clips and clusters."""
