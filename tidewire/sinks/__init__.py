"""Writers: posts, spools, raw files, trouble reports."""
