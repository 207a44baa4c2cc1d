"""Steps, handles, runs and the patterns built from them."""
