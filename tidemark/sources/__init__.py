"""Where bars and instruments come from and go to."""
