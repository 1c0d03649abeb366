"""Where catalogs and requests come from and where results go."""
