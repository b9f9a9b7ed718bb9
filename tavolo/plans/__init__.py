from tavolo.plans.session import BASE_CONF, cut_lineage, ensure_checkpoint_dir, local_session

__all__ = ["BASE_CONF", "cut_lineage", "ensure_checkpoint_dir", "local_session"]
