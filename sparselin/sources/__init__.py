"""Readers: LIBSVM/SVMlight text, tables as examples, weights, run logs."""
