"""A codec that isn't the library's: ids as differences to the one before."""

import numpy as np

from vertexloom.sources.csr import Codec

GAPS = Codec(("idx9", "adj9"), lambda ids, options: np.diff(ids, prepend=0), np.cumsum)
