"""pairlake: PySpark analytics for collections of clean/noisy image pairs."""
