"""Pixel kernels in numpy, for use in Arrow UDFs."""
