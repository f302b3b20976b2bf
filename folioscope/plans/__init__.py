"""Relations that say what to compute next: ranks and page plans."""
