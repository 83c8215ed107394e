"""Where turns come from: transcript files, record decoders, tables."""
